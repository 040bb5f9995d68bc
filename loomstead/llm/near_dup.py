"""MinHash near-dedup: SuperMinHash signatures, banding, exact verification on full shingle sets, union-find grouping.

SuperMinHash gives each element a permutation of the slots and in slot p[j] the rank j plus a fraction, so that the
values in one signature are negatively correlated; an element's permutation is followed only as deep as some slot of its
document still has a value over the depth. Documents with equal sets are one class. Classes that share a band form
clusters. Links are confirmed on full sets, by prefix filtering over the rarest shingles, in cells of a bounded number of
documents and shingles; a cell gives only the links that join its groups, and pairs are never emitted.

1. A cluster that fits is one cell. A larger one is dealt into blocks by a hash, each a cell that also holds the cluster's
   pivots (about ``PIVOTS`` of its documents), so that a family of copies comes out as one group in one pass.
2. Of larger clusters with several groups left, the shingles that two groups share are counted over the whole cluster.
   Taking all others to be rarer, two documents of different groups can only be linked if they share one of their rarest
   ``n - ceil(threshold * n) + 1`` shingles. Documents that share none are done; the rest fall into new clusters by those
   shingles, which are compared as in 1, with all pairs of blocks where one is still too large for a cell.

A text is sent once for step 1, once for its shingles, and once for its new cluster. A pair exactly at the threshold shares
no band with a probability of about 2e-9; every other step is exact.

Defined cases: texts that are null or without words have an empty set and are linked with nothing, and so are rows with a
null id (their component is null and they are kept). Rows that share an id are one document: what links either links both.
Ids are whole numbers; a text id that isn't one counts as null. An empty table gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .runtime import need, ship, shuffle_width, stored, table
from .text import U, distinct, mix, pieces, shingle_sets, shingles, utf8, words

#: A block has about so many documents or shingles, and a cell one or two blocks.
BLOCK_DOCS, BLOCK_SHINGLES = 1000, 400_000
#: Members of clusters that are broadcast to the texts at most.
BROADCAST_MEMBERS = 500_000
#: Documents of a large cluster that every block of it is compared with, and slots of a signature.
PIVOTS, SLOTS = 16, 256
_RANK = 40


def super_minhash(values: np.ndarray, off: np.ndarray, slots: int) -> np.ndarray:
    """The signature of each row's set: ``slots`` numbers, rank << 40 plus a 40-bit fraction; an empty row has all ones."""
    rows = len(off) - 1
    out = np.full(rows * slots, np.iinfo(U).max, U)
    row = np.repeat(np.arange(rows), np.diff(off))

    def dice(x: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            z = mix(x ^ mix(np.full(1, U(j + 1))))
            k = j + (((z & U(0xFFFFFF)) * U(slots - j)) >> U(24)).astype(np.int64)
        return k, (U(j) << U(_RANK)) | (z >> U(24))

    k, v = dice(values, 0)
    np.minimum.at(out, row * slots + k, v)
    sig = out.reshape(rows, slots)
    open_rows = np.flatnonzero((sig.max(1) >= U(1 << _RANK)) & (np.diff(off) > 0))
    most = max(1, (8 << 20) // slots)
    while len(open_rows):
        sizes = np.cumsum(off[open_rows + 1] - off[open_rows])
        n = max(1, int(np.searchsorted(sizes, most, side="right")))
        some, open_rows = open_rows[:n], open_rows[n:]
        at = np.concatenate([np.arange(off[r], off[r + 1]) for r in some])
        own, x = row[at], values[at]
        order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(at), 1))
        lines = np.arange(len(at))
        for j in range(slots):
            k, v = dice(x, j)
            taken = order[lines, k]
            order[lines, k] = order[lines, j]
            if j:
                np.minimum.at(out, own * slots + taken, v)
            live = np.zeros(rows, bool)
            live[some] = sig[some].max(1) >= U((j + 1) << _RANK)
            keep = live[own]
            if not keep.any():
                break
            if keep.sum() < 0.7 * len(keep):
                own, x, order = own[keep], x[keep], order[keep]
                lines = np.arange(len(own))
    return sig


def banding(threshold: Fraction) -> tuple[int, int]:
    """(bands, rows of a band) within ``SLOTS``; at 0.85 and 0.8 a pair at the threshold is missed with a probability of about 2e-9."""
    rows = 6 if threshold >= Fraction(85, 100) else 5 if threshold >= Fraction(3, 4) else 3
    return SLOTS // rows, rows


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(id, n, d1, d2, bands): the size of each row's set, a 128-bit digest of it and a hash of each band."""

    def signed(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                h, woff, _ = words(*utf8(part.column("text")))
                sets, off = distinct(*shingles(h, woff, k)[:2])
                n = np.diff(off)
                sig = super_minhash(sets, off, bands * rows)
                with np.errstate(over="ignore"):
                    sums = [np.diff(np.concatenate([np.zeros(1, U), np.cumsum(mix(sets ^ U(c)))])[off]) for c in (0, 0x9E3779B9)]
                    band = np.zeros((len(n), bands), U)
                    for i in range(rows):
                        band = mix(band ^ sig[:, i::rows])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, pa.int32()), pa.array(band.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").cast(pa.int64()), pa.array(n.astype(np.int64)), *(pa.array(mix(s ^ n.astype(U)).view(np.int64)) for s in sums), lists], ["id", "n", "d1", "d2", "bands"])

    return docs.mapInArrow(signed, "id long, n long, d1 long, d2 long, bands array<long>")


def linked(sets: list[np.ndarray], block: np.ndarray, threshold: Fraction, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the sets with a Jaccard similarity of at least ``threshold`` into their groups, in a cell.

    Where there are two blocks, only pairs from both are compared; sets of one group in ``known`` are joined already. Exact: two sets that reach the threshold share one of
    their rarest ``n - ceil(threshold * n) + 1`` elements, by one order of all.
    """
    p, q = threshold.numerator, threshold.denominator
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, token, freq = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.lexsort((token, freq[token], owner))
    token = token[order]
    off = np.concatenate([[0], np.cumsum(size)])
    prefix = size - -(-p * size // q) + 1
    in_prefix = np.arange(len(token)) - np.repeat(off[:-1], size) < np.repeat(prefix, size)
    at = np.flatnonzero(in_prefix & (freq[token] > 1))
    by = at[np.argsort(token[at], kind="stable")]
    owners, tokens = owner[by], token[by]
    opens = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, int)
    first, last = np.zeros(len(freq), np.int64), np.zeros(len(freq), np.int64)
    first[tokens[opens]], last[tokens[opens]] = opens, np.append(opens[1:], len(tokens))
    two = len(np.unique(block)) > 1
    group, found = np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1], []
    seen = np.zeros(len(freq), bool)
    per_doc = np.searchsorted(at, off)
    for x in range(len(sets)):
        own = token[at[per_doc[x] : per_doc[x + 1]]]
        if not len(own):
            continue
        others = np.unique(np.concatenate([owners[first[t] : last[t]] for t in own]))
        others = others[(others < x) & (group[others] != group[x]) & (q * np.minimum(size[others], size[x]) >= p * np.maximum(size[others], size[x]))]
        if two:
            others = others[block[others] != block[x]]
        if not len(others):
            continue
        seen[token[off[x] : off[x + 1]]] = True
        for some in np.array_split(others, 1 + size[others].sum() // 4_000_000):
            ends = np.cumsum(size[some])
            where = np.arange(ends[-1]) - np.repeat(ends - size[some] - off[some], size[some])
            common = np.add.reduceat(seen[token[where]].astype(np.int64), ends - size[some])
            for y in some[q * common >= p * (size[some] + size[x] - common)]:
                if group[y] != group[x]:
                    found.append((x, int(y)))
                    group[group == group[y]] = group[x]
        seen[token[off[x] : off[x + 1]]] = False
    return found


def _verify(k: int, threshold: Fraction):
    def verified(batches):
        cell, rows, sets = None, [], []

        def links() -> pa.RecordBatch:
            ids, blocks, known = zip(*rows, strict=True) if rows else ((), (), ())
            found = linked(sets, np.array(blocks), threshold, np.array(known)) if len(sets) > 1 else []
            a, b = ([ids[p[i]] for p in found] for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for part in pieces(batch, "text"):
                values, off = shingle_sets(part.column("text"), k)
                keys, own = (zip(*(part.column(c).to_pylist() for c in names), strict=True) for names in (("cluster", "x", "y"), ("id", "block", "known")))
                for r, (key, row) in enumerate(zip(keys, own, strict=True)):
                    if key != cell:
                        if len(sets) > 1:
                            yield links()
                        cell, rows, sets = key, [], []
                    rows.append(row)
                    sets.append(values[off[r] : off[r + 1]].copy())
        yield links()

    return verified


def _bounded(members: DataFrame) -> DataFrame:
    """``members`` to be joined with the texts: broadcast up to ``BROADCAST_MEMBERS`` rows of some 50 bytes; beyond, the join shuffles."""
    members = stored(members, "cells")
    return F.broadcast(members) if members.count() <= BROADCAST_MEMBERS else members.hint("merge")


def _confirmed(docs: DataFrame, cells: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """Links (a, b) within ``cells`` (node, cluster, x, y, block, known): a cell is a cluster's pair of blocks x and y."""
    cells = _bounded(cells)
    texts = docs.join(cells, docs["id"] == cells["node"]).select("id", "text", "cluster", "x", "y", "block", "known")
    dealt = texts.repartition(shuffle_width(docs.sparkSession), "cluster", "x", "y").sortWithinPartitions("cluster", "x", "y", "id")
    return stored(dealt.mapInArrow(_verify(k, threshold), "a long, b long"), "confirmed")


def _parts(members: DataFrame) -> DataFrame:
    """(cluster, many, parts) of (cluster, n, ...): documents, and the blocks that they need."""
    many, sums = F.count("*"), F.sum("n")
    return members.groupBy("cluster").agg(many.alias("many"), F.greatest(F.ceil(many / BLOCK_DOCS), F.ceil(sums / BLOCK_SHINGLES)).alias("parts"))


def _stars(rows: DataFrame, *bucket: str) -> DataFrame:
    """Links (node, center) of the nodes in a bucket to the smallest node in it."""
    firsts = rows.groupBy(*bucket).agg(F.min("node").alias("center"), F.max("node").alias("other")).where("center <> other").drop("other")
    firsts = stored(firsts, "firsts")  # with both sides of the join read anew, a bucket of very many rows can be split
    return rows.join(firsts, [*bucket]).where("node <> center").select("node", "center")


def _rare_clusters(docs: DataFrame, members: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """(node, cluster, n) of those ``members`` (node, cluster, known) that may be linked to another group of their cluster."""

    def listed(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                values, off = shingle_sets(part.column("text"), k)
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "cluster", "known")), lists], ["node", "cluster", "known", "shingles"])

    members = _bounded(members)
    texts = docs.join(members, docs["id"] == members["node"]).select("node", "cluster", "known", "text")
    sets = stored(texts.mapInArrow(listed, "node long, cluster long, known long, shingles array<long>"), "sets")
    rows = sets.select("cluster", "node", "known", F.size("shingles").alias("n"), F.xxhash64("shingles").alias("own"), F.explode("shingles").alias("shingle"))
    common = rows.groupBy("cluster", "shingle").agg(F.count("*").alias("often"), F.min("known").alias("a"), F.max("known").alias("b")).where("a < b").drop("a", "b")
    common = stored(common, "common")
    shared = rows.join(common, ["cluster", "shingle"]).groupBy("cluster", "node", "own").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("shared"))
    p, q = threshold.numerator, threshold.denominator
    rarest = F.size("shared") - F.ceil(p * F.col("n") / F.lit(q)) + 1
    prefix = shared.where(rarest > 0).select("cluster", "node", F.explode(F.slice("shared", F.lit(1), rarest.cast("int"))).alias("s")).select("cluster", "node", "s.shingle")
    found = components(_stars(prefix, "cluster", "shingle")).toDF("node", "rare")
    return found.join(sets.groupBy("node").agg(F.max(F.size("shingles")).alias("n")), "node").select("node", F.col("rare").alias("cluster"), "n")


def _groups(docs: DataFrame, members: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """(node, component) of the linked ones among ``members`` (node, cluster, n)."""
    members = members.groupBy("node", "cluster").agg(F.sum("n").alias("n"))
    sized = stored(members.join(_parts(members), "cluster"), "sized")
    block = F.pmod(F.xxhash64("node"), F.col("parts"))
    pivot = (F.col("parts") > 1) & (F.pmod(F.xxhash64("node", F.lit(PIVOTS)), F.ceil(F.col("many") / PIVOTS)) == 0)
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    cells = sized.select("node", "cluster", F.explode(F.when(pivot, every).otherwise(F.array(block))).alias("x"))
    cells = cells.select("node", "cluster", "x", F.col("x").alias("y"), F.lit(0).cast("long").alias("block"), F.col("node").alias("known"))
    links = _confirmed(docs, cells, k, threshold)
    groups = components(links)
    large = sized.where("parts > 1").select("node", "cluster")
    if not large.limit(1).count():
        return groups
    known = stored(large.join(groups, "node", "left").select("node", "cluster", F.coalesce("component", "node").alias("known")), "known")
    several = known.groupBy("cluster").agg(F.min("known").alias("a"), F.max("known").alias("b")).where("a < b").select("cluster")
    left = stored(known.join(several, "cluster", "left_semi"), "left")
    rare = stored(_rare_clusters(docs, left, k, threshold), "rare")
    block, every = F.pmod(F.xxhash64("node"), F.col("parts")), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    dealt = rare.join(_parts(rare), "cluster").join(left.select("node", "known"), "node").select("node", "cluster", "known", block.alias("block"), F.explode(every).alias("other"))
    cells = dealt.select("node", "cluster", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "known")
    return components(links.union(_confirmed(docs, cells, k, threshold)))


def near_duplicates(docs: DataFrame, k: int = 5, threshold: Fraction = Fraction(80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``."""
    ship(docs.sparkSession)
    docs = need(docs, id=id_col, text=text_col).withColumn("id", F.expr("try_cast(id AS bigint)"))
    signed = stored(signatures(docs, k, *banding(threshold)), "signatures")
    classes = stored(signed.where("n > 0 AND id IS NOT NULL").groupBy("d1", "d2").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    clusters = components(_stars(classes.select("node", F.posexplode("bands").alias("band", "hash")), "band", "hash")).toDF("node", "cluster")
    groups = _groups(docs.where("id IS NOT NULL"), classes.select("node", "n").join(clusters, "node").select("node", "cluster", "n"), k, threshold)
    classed = classes.select("d1", "d2", "node").join(groups, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component"))
    out = signed.select("id", "n", "d1", "d2").join(classed, ["d1", "d2"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, Fraction(85, 100))


def near_dup_sql(k: int, p: int, docs: str = "documents") -> str:
    """DuckDB SQL for the rows of ``near_duplicates`` with a threshold of p / 100: every pair with a common shingle, then the closure of the links."""
    grams = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""
WITH RECURSIVE cut AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {docs}),
sets AS (SELECT doc_id, CASE WHEN len(w) >= {k} THEN list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: {grams}))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM cut),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY 1),
items AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM classes),
often AS (SELECT g FROM items GROUP BY g HAVING count(*) > 1),
common AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
    FROM items a JOIN items b ON a.g = b.g AND a.rep < b.rep WHERE a.g IN (SELECT g FROM often) GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * c >= {p} * (na + nb - c) UNION ALL SELECT b, a FROM common WHERE 100 * c >= {p} * (na + nb - c)),
reach AS (SELECT rep AS node, rep AS seen FROM classes UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
roots AS (SELECT node, min(seen) AS root FROM reach GROUP BY node)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, coalesce(r.root, d.doc_id) = d.doc_id AS kept
FROM sets d LEFT JOIN classes c ON list_sort(d.s) = c.s LEFT JOIN roots r ON r.node = c.rep
"""


OP3_SQL = near_dup_sql(3, 85)
