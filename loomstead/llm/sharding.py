"""Sharding by sampled splitters: size-weighted key samples give quantile boundaries, records are range-partitioned.

The key is a hash of the text, so equal texts are one range and stay together. A sample of keys, weighted by size, gives the
boundaries of ``shards * FINE`` ranges of about equal bytes; every record goes to its range by them. A range with more bytes
than ``1 / FINE`` of a shard, or more than ``RANGE_ROWS`` rows, is subdivided: into pieces of equal width of its keys, and a
text with so many copies that it fills a range alone by a hash of the document's id. Shards are runs of pieces in key order, each
piece going where its middle falls, so under law ``bytes`` a shard's bytes differ from the mean by about one piece.

Defined cases: a null text has size 1 and the CRC of the empty string; null or repeated ids are placed like others, rows
alike in all columns being interchangeable; an empty table gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import need, ship, stored, table

#: Ranges for each shard, and rows of a range or piece at most.
FINE, RANGE_ROWS = 200, 50_000
#: Keys sampled for the boundaries (a bound on what the driver reads).
SAMPLE = 60_000


def splitters(keys: DataFrame, total: int, ranges: int) -> np.ndarray:
    """Boundaries of ``ranges`` ranges of ``key`` with about equal bytes, from a size-weighted sample of (key, bytes)."""
    chance = F.least(F.lit(1.0), F.col("bytes") * F.lit(SAMPLE / max(total, 1)))
    dice = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = keys.where(dice < chance).select("key", (F.col("bytes") / chance).alias("weight")).toPandas().sort_values("key")
    if not len(drawn):
        return np.zeros(0, np.int64)
    share = np.cumsum(drawn["weight"].to_numpy())
    at = np.searchsorted(share, share[-1] * np.arange(1, ranges) / ranges)
    return np.unique(drawn["key"].to_numpy()[np.minimum(at, len(drawn) - 1)])


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(need(docs, id=id_col, text=text_col).select("id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("key")), "sizes")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bound = max(1, total // (shards * FINE))
    sums = (F.sum("size").alias("bytes"), F.count("*").alias("n"))
    keys = stored(rows.groupBy("key").agg(*sums), "keys")
    edges = splitters(keys, total, shards * FINE)
    lows = np.concatenate([[np.iinfo(np.int64).min], edges])
    widths = np.diff(np.append(lows.astype(float), float(np.iinfo(np.int64).max)))

    def ranged(batches):
        for b in batches:
            at = np.searchsorted(edges, b.column("key").to_numpy(zero_copy_only=False), side="right")
            share = (b.column("key").to_numpy(zero_copy_only=False) - lows[at].astype(float)) / np.maximum(widths[at], 1.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), pa.array(np.clip(share, 0, 1 - 1e-9))], [*b.schema.names, "range", "share"])

    placed = stored(keys.mapInArrow(ranged, "key long, bytes long, n long, range long, share double"), "ranged")
    alone = (F.col("n") > 1) & ((F.col("bytes") > bound) | (F.col("n") > RANGE_ROWS))
    pieces_of = lambda size, n: F.greatest(F.ceil(size / bound), F.ceil(n / F.lit(RANGE_ROWS)), F.lit(1))
    many = placed.where(~alone).groupBy("range").agg(F.sum("bytes").alias("b"), F.sum("n").alias("m")).select("range", pieces_of(F.col("b"), F.col("m")).alias("parts"))
    cut = placed.join(F.broadcast(many), "range", "left")  # a row for each range
    # a much-copied text is a range of its own behind the pieces of its range, named by its key
    cut = cut.select("key", "range", F.when(alone, F.col("key")).alias("hot"), F.when(alone, F.lit(0)).otherwise(F.floor(F.col("share") * F.col("parts"))).alias("piece"), F.when(alone, pieces_of(F.col("bytes"), F.col("n"))).otherwise(1).alias("copies"))
    dealt = rows.join(cut, "key").select("id", "size", "crc", "range", "hot", F.when(F.col("hot").isNull(), F.col("piece")).otherwise(F.pmod(F.xxhash64("id", "size"), F.col("copies"))).cast("long").alias("piece"))
    dealt = stored(dealt, "dealt")
    pieces = stored(dealt.groupBy("range", "hot", "piece").agg(*sums), "pieces")
    of_range = pieces.groupBy("range").agg(F.sum("bytes").alias("b")).orderBy("range").toPandas()  # a row for each range
    begins = spark.createDataFrame(list(zip(of_range["range"].tolist(), (of_range["b"].cumsum() - of_range["b"]).tolist(), strict=True)), "range long, begin long")
    order = [F.col("hot").asc_nulls_first(), F.col("piece")]
    before = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("begin") + F.coalesce(F.sum("bytes").over(before), F.lit(0)) + F.col("bytes") / 2
    pieces = pieces.join(F.broadcast(begins), "range").select("range", "hot", "piece", "n", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(total, 1)))).cast("int").alias("shard"))
    pieces = stored(pieces, "placed")
    firsts = pieces.groupBy("shard", "range").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    firsts = firsts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    before = Window.partitionBy("shard", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.join(F.broadcast(firsts), ["shard", "range"]).select("range", "hot", "piece", "shard", (F.col("first") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("base"))
    inside = Window.partitionBy("range", "hot", "piece").orderBy("id", "size", "crc")
    ranked = dealt.withColumn("place", F.row_number().over(inside))
    same = (ranked["range"] == pieces["range"]) & ranked["hot"].eqNullSafe(pieces["hot"]) & (ranked["piece"] == pieces["piece"])
    return ranked.join(pieces, same).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))
