"""URL filters: a blocked Bloom filter of listed canonical URLs passes possible hits to an exact hash join.

A listed entry is a host and a path prefix with a verdict. It fits a URL whose host is that host or a subdomain of it
and whose path starts with that prefix; the longest fitting entry decides, and a URL that none fits is allowed.
Everything is DataFrame code: no Python runs on the executors.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits nothing and is allowed. Repeated rows
are judged alike, each keeping its row. Entries listed twice count once; listed as both, ``block`` holds. Ties in length
go to the longer host. An empty list allows all. Extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import need, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8
#: Odd multipliers, one for each 32-bit word of a block.
SALTS = [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31]
BITS_PER_KEY = 16
#: A filter of at most so many bytes is broadcast; a larger one is joined by block.
BROADCAST_BYTES = 8 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _key(host: Column, path: Column) -> Column:
    return F.xxhash64(host, path)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(key, 32), F.lit(blocks))


def _bit(key: Column, i: int) -> Column:
    """The bit of word ``i``: the top 5 bits of a 32-bit product."""
    low = key.bitwiseAND(F.lit(0xFFFFFFFF))
    place = F.shiftrightunsigned((low * F.lit(SALTS[i] >> 1 | 1)).bitwiseAND(F.lit(0xFFFFFFFF)), 27)
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """One row for each block in use: ``block`` and its words ``w0`` to ``w7``."""
    key = _key(F.col("rule_host"), F.col("rule_path"))
    bits = listed.select(_block(key, blocks).alias("block"), *[_bit(key, i).alias(f"w{i}") for i in range(WORDS)])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def possible(candidates: DataFrame, listed: DataFrame, n: int) -> DataFrame:
    """Those of ``candidates`` (rule_host, rule_path, ...) that the filter of ``listed``, with ``n`` rows, lets pass."""
    blocks = max(1, -(-n * BITS_PER_KEY // (32 * WORDS)))
    words = bloom(listed, blocks)
    if blocks * (WORDS + 1) * 8 <= BROADCAST_BYTES:
        words = F.broadcast(words)
    key = _key(F.col("rule_host"), F.col("rule_path"))
    found = candidates.withColumn("key", key).withColumn("block", _block(F.col("key"), blocks)).join(words, "block")
    for i in range(WORDS):
        found = found.where(F.col(f"w{i}").bitwiseAND(_bit(F.col("key"), i)) != 0)
    return found.drop("block", "key", *[f"w{i}" for i in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``pages`` as (id, host, path, rule, verdict). ``listed``: (rule_host, rule_path, rule_verdict).

    Path lengths that occur in the list are read by the driver: at most as many as the longest listed path has characters.
    """
    listed = listed.where("rule_host IS NOT NULL AND rule_path IS NOT NULL").groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
    lengths = sorted(r[0] for r in listed.select(F.length("rule_path")).distinct().collect())
    n = listed.count()
    rows = need(pages, id=id_col, url=url_col)
    host, path = host_and_path(F.col("url"))
    rows = rows.select(F.col("id"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(x) for x in lengths] or [F.lit(-1)]), lambda x: (x >= 0) & (x <= F.length("path"))), lambda x: F.substring(F.col("path"), F.lit(1), x))
    asked = rows.select("host", "path").where("host <> ''")
    candidates = asked.select("host", "path", F.explode(suffixes).alias("rule_host"), prefixes.alias("prefixes")).select("host", "path", "rule_host", F.explode("prefixes").alias("rule_path"))
    hits = possible(candidates, listed, n).distinct().join(listed, ["rule_host", "rule_path"])
    best = F.max(F.struct(F.length(F.concat("rule_host", "rule_path")).alias("long"), F.length("rule_host").alias("host_long"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")))
    decided = hits.groupBy("host", "path").agg(best.alias("best"))
    return rows.join(decided, ["host", "path"], "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict")
    )


#: The rules of the query.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(RULES, "rule_host string, rule_path string, rule_verdict string")
    return judge(table(spark, sf_dir, "pages"), listed)


OP9_SQL = """
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
cut AS (SELECT page_id, row_number() OVER () AS n,
          CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, n, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
parts AS (SELECT page_id, n, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
fits AS (SELECT n, rule_host || rule_path AS rule, rule_verdict,
           row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS k
         FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) f USING (n)
""".format(rules=", ".join(str(r) for r in RULES))
