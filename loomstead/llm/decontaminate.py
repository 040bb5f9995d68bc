"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by the size of their shingle set (powers of two) and sketched by one permutation: for items of up
to ``m`` shingles the hash range has ``4 m`` bins and each bin keeps its least hash, so a sketch is most of a small item. An
item with at least ``threshold`` of its shingles in a document lacks at most the rest there, and so does its sketch: it is a
candidate if all but that many of its sketch's hashes are in the document, wherever they stand, and stays if enough of its
shingles are. No item is lost so; one whose sketch is no larger than what it may lack is looked up by all its shingles.

Items go to the tasks in blocks of at most ``BLOCK`` shingles; a larger benchmark takes several passes over the documents.

Defined cases: null texts and texts without words hold nothing, and such items are in no document; with fewer words than a
shingle has, the whole text is one shingle. Each row of documents is reported on its own, with a null id too; each row of
items likewise. Empty tables give an empty result. Extra columns are not carried.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import need, ship, stored, table
from .text import U, pieces, shingle_sets, shingles, utf8, words

K, THRESHOLD = 5, Fraction(80, 100)
#: Shingles of the items that a task holds at once: 8 bytes each, and up to twice as much again for their sketches.
BLOCK = 1_000_000
#: Bits of the table that first tells whether a hash is in some item's sketch.
_BITS = 22


def item_sets(items: DataFrame, k: int) -> DataFrame:
    """(item, n, set) of the items (item, text) that have words."""

    def made(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                sets, off = shingle_sets(part.column("text"), k)
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("item").cast(pa.int64()), pa.array(np.diff(off)), lists], ["item", "n", "set"])

    return items.mapInArrow(made, "item long, n long, set array<long>").where("n > 0")


def _minima(values: np.ndarray, bins: int) -> np.ndarray:
    """The least hash of each bin in use."""
    values = np.unique(values)
    return values[np.unique(values % U(bins), return_index=True)[1]]


class Sketches:
    """The sketches of a block of items by size class."""

    def __init__(self, sets: list[np.ndarray], threshold: Fraction):
        self.sets = sets
        size = np.array([len(s) for s in sets])
        lack = np.array([int(n) - -(-threshold.numerator * int(n) // threshold.denominator) for n in size])
        minima = [_minima(s, 4 << int(len(s) - 1).bit_length()) for s in sets]
        minima = [m if len(m) > few else s for m, few, s in zip(minima, lack, sets, strict=True)]
        held = np.array([len(m) for m in minima])
        #: How many of its sketch's hashes a document with enough of an item holds at least.
        self.least = held - lack
        values, item = np.concatenate(minima), np.repeat(np.arange(len(sets)), held)
        order = np.argsort(values, kind="stable")
        self.values, self.item = values[order], item[order]
        self.table = np.zeros(1 << _BITS, bool)
        self.table[self.values >> U(64 - _BITS)] = True

    def candidates(self, whole: np.ndarray) -> np.ndarray:
        """Items with enough of their sketch in ``whole``, the distinct hashes of a document."""
        near = whole[self.table[whole >> U(64 - _BITS)]]
        a, b = np.searchsorted(self.values, near), np.searchsorted(self.values, near, side="right")
        n = b - a
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, hits = np.unique(self.item[at], return_counts=True)
        return item[hits >= self.least[item]]


def contained(docs: DataFrame, items: DataFrame, k: int = K, threshold: Fraction = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, n_shingles, n_shared) for every document and item with at least ``threshold`` of the item's shingles in the document."""
    spark = docs.sparkSession
    ship(spark)
    docs = need(docs, id=id_col, text=text_col)
    listed = stored(item_sets(need(items, item=item_col, text=item_text), k), "items")
    total = listed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = -(-total // BLOCK)
    p, q = threshold.numerator, threshold.denominator
    kind = docs.schema["id"].dataType.simpleString()

    def search(block: int) -> DataFrame:
        rows = listed.where(F.pmod(F.xxhash64("set", "item"), F.lit(blocks)) == block).select("item", "set").toArrow()
        names = rows.column("item").combine_chunks()
        sets = [np.array(s, np.int64).view(U) for s in rows.column("set").to_pylist()]
        sketches = Sketches(sets, threshold) if sets else None

        def searched(batches):
            for batch in batches:
                for part in pieces(batch, "text"):
                    h, woff, _ = words(*utf8(part.column("text")))
                    h, off, _ = shingles(h, woff, k)
                    row, item, shared = [], [], []
                    near = np.concatenate([[0], np.cumsum(sketches.table[h >> U(64 - _BITS)])])[off]
                    for r in np.flatnonzero(np.diff(near)):
                        whole = np.unique(h[off[r] : off[r + 1]])
                        for i in sketches.candidates(whole).tolist():
                            n = len(np.intersect1d(sets[i], whole, assume_unique=True))
                            if q * n >= p * len(sets[i]):
                                row.append(r)
                                item.append(i)
                                shared.append(n)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(pa.array(row, pa.int64())), names.take(pa.array(item, pa.int64())), pa.array([len(sets[i]) for i in item], pa.int64()), pa.array(shared, pa.int64())],
                        ["id", "item", "n_shingles", "n_shared"])

        return docs.mapInArrow(searched, f"id {kind}, item long, n_shingles long, n_shared long")

    none = spark.createDataFrame([], f"id {kind}, item long, n_shingles long, n_shared long")
    found = reduce(DataFrame.union, [search(b) for b in range(blocks)], none) if blocks != 1 else search(0)
    return found.toDF(id_col, item_col, "n_shingles", "n_shared")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SETS = """{name}_cut AS (SELECT {id}, row_number() OVER () AS {name}_row, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table}),
{name} AS (SELECT {id}, {name}_row, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM {name}_cut)"""


def contained_sql(docs: str = "documents") -> str:
    parts = _SETS.format(name="d", id="doc_id", table=docs), _SETS.format(name="i", id="item_id", table="benchmark")
    return f"""
WITH {parts[0]}, {parts[1]},
sizes AS (SELECT i_row, count(*) AS n FROM i GROUP BY 1),
shared AS (SELECT any_value(doc_id) AS doc_id, any_value(item_id) AS item_id, d_row, i_row, count(*) AS c FROM d JOIN i USING (g) GROUP BY d_row, i_row)
SELECT doc_id, item_id, n AS n_shingles, c AS n_shared FROM shared JOIN sizes USING (i_row) WHERE 100 * c >= 80 * n
"""


OP1_SQL = contained_sql()
