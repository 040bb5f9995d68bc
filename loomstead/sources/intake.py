"""Text files of a corpus to typed documents: identity signals, dates and keys, as one projection over a file scan.

Files lie under ``root/<source>/<folders>/dsid_<hex>__<slug>.txt``; the first line is the title, and ``dsid_<hex>`` the id.
Undecodable bytes are replaced. All fields are empty rather than null, so that equality means the same everywhere. Files that
can't be a document (no source folder) are kept apart with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

# The patterns of the corpus's conventions.
FILE_NAME = r"^(dsid_[0-9a-f]+)__(.*)\.txt$"
HEADERS = ["From", "To", "Cc", "Bcc", "Date", "Subject", "Attachments"]
PERSON = r"[A-Z][\w'’.-]*(?:\s+[A-Z][\w'’.-]*)+"
NAMED_EMAIL = rf"(?U)({PERSON})\s*<([^>]+)>"
CHAT_LINE = r"(?m)^([a-z0-9][\w.\-]{1,24}):\s+\S"
CALL_TURN = r"(?m)^\[\d{1,2}:\d{2}(?::\d{2})?\]\s+([^:\n]{2,60}?):\s+\S"
ATTENDEES = r"(?m)^Attendees\s*\(([^)]+)\)\s*:\s*(.+)$"
NO_ORGANISATION = r"(?i)^(?:as\s+)?(?:recorded|listed|captured|noted|above|below|n/?a|unknown|tbd)$"
ACTION = rf"(?mU)^({PERSON})\s+-\s+\S"
MENTION = r"(?<![\w.+-])@([\w.\-]{2,32})"
CHANNEL = r"#([\w\-]{2,40})"
BOT = r"(?i)(?:^|[-_])(?:bot|ci|cd|jenkins|webhook|noreply|no-reply)(?:$|[-_])|^(?:deploy|ops|infra|build|release|alert)[-_]"
TICKET, SLUG_DATE, THREAD, STATED_DATE = r"^([A-Za-z]{2,10}-\d+)", r"^(\d{4}-\d{2}-\d{2})-", r"^(\d{6,})-", r"(?m)^Date:\s*(\d{4}-\d{2}-\d{2})"
MOST_MENTIONS, MOST_CHANNELS = 64, 32


#: What a scan of binary files has.
FILES = "path string, modificationTime timestamp, length long, content binary"


def as_files(scan: DataFrame) -> DataFrame:
    """(path, raw) of a binary file scan; bytes that are no UTF-8 become replacement characters. Spark lists no files of zero bytes."""
    return scan.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("raw"))


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, raw) of every text file under ``root``."""
    return as_files(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(root))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _only(source: str, value: Column) -> Column:
    return F.when(F.col("source") == source, value).otherwise(F.array().cast("array<string>"))


def parse(files: DataFrame, root: str) -> DataFrame:
    """Documents of (path, raw). ``root`` is what comes before the source's folder in a path."""
    part = F.split(F.regexp_replace("path", "^.*?" + root.rstrip("/").split("/")[-1] + "/", ""), "/")
    df = files.withColumn("part", part).withColumn("file", F.element_at("part", -1))
    slug = F.regexp_extract("file", FILE_NAME, 2)
    stem = F.regexp_replace("file", r"\.txt$", "")
    df = df.withColumn("slug", F.when(slug != "", slug).otherwise(stem)).withColumn("doc_id", F.coalesce(F.nullif(F.regexp_extract("file", FILE_NAME, 1), F.lit("")), F.col("slug")))
    df = df.withColumn("source", F.get("part", F.lit(0))).withColumn("folders", F.slice("part", 2, F.greatest(F.size("part") - 2, F.lit(0))))
    df = df.withColumn("text", F.replace("raw", F.lit("\\n"), F.lit("\n"))).withColumn("title", X.title(F.col("text"))).withColumn("body", X.body(F.col("text")))
    block = F.when(F.col("source") == "gmail", F.regexp_extract("body", rf"^\s*((?:(?:{'|'.join(HEADERS)}):[^\n]*(?:\n|$))+)", 1)).otherwise("")
    df = df.withColumn("block", block).withColumn("body", F.when(F.col("block") != "", F.regexp_replace(F.substring(F.col("body"), F.length("block") + 1, F.length("body")), r"^\s+", "")).otherwise(F.col("body")))
    pairs = [F.struct(F.lit(h.lower()).alias("k"), F.trim(F.regexp_extract("block", rf"(?m)^{h}:(.*)$", 1)).alias("v")) for h in HEADERS]
    df = df.withColumn("headers", F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"] != "")))
    text = F.col("text")
    named = F.arrays_zip(found(text, NAMED_EMAIL, 1).alias("name"), F.transform(found(text, NAMED_EMAIL, 2), F.lower).alias("email"))
    talk = F.concat(_only("slack", found(F.col("body"), CHAT_LINE)), _only("fireflies", F.transform(found(F.col("body"), CALL_TURN), lambda x: F.trim(x))), _only("fireflies", found(F.col("body"), ACTION)))
    guests = F.when(F.col("source") == "fireflies", F.flatten(F.transform(F.arrays_zip(found(text, ATTENDEES, 1).alias("org"), found(text, ATTENDEES, 2).alias("names")), lambda g: F.transform(
        F.split(g["names"], r"\s*,\s*"), lambda n: F.struct(F.trim(n).alias("name"), F.when(F.trim(g["org"]).rlike(NO_ORGANISATION), "").otherwise(F.trim(g["org"])).alias("org")))))).otherwise(F.array().cast("array<struct<name:string,org:string>>"))
    guests = F.filter(guests, lambda g: g["name"] != "")
    mentions = F.array_distinct(found(text, MENTION))
    own = F.when((F.col("source") == "slack") & (F.col("title") != "") & ~F.contains("title", F.lit(" ")), F.array(F.regexp_replace("title", "^#", ""))).otherwise(F.array().cast("array<string>"))
    bot = lambda x: x.rlike(BOT)
    df = df.withColumn("talk", F.array_distinct(talk)).withColumn("named_mentions", F.slice(mentions, 1, MOST_MENTIONS))
    date = F.coalesce(*[F.nullif(d, F.lit("")) for d in (F.regexp_extract("slug", SLUG_DATE, 1), F.regexp_extract("body", STATED_DATE, 1), F.element_at("headers", "date"))], F.lit(""))
    return df.select(
        "doc_id", "source", "title", "body", "slug", "folders", X.emails(text).alias("emails"), F.array_distinct(named).alias("named_emails"),
        F.filter("talk", lambda x: ~bot(x)).alias("speakers"), F.filter("named_mentions", lambda x: ~bot(x)).alias("mentions"),
        F.slice(F.array_distinct(F.concat(own, found(text, CHANNEL))), 1, MOST_CHANNELS).alias("channels"), "headers", F.array_distinct(guests).alias("attendees"),
        F.array_distinct(F.filter(F.concat("named_mentions", "talk"), bot)).alias("bots"), F.upper(F.regexp_extract("slug", TICKET, 1)).alias("ticket_key"), date.alias("date"), F.regexp_extract("slug", THREAD, 1).alias("thread_id"),
    )


def misplaced(files: DataFrame, root: str) -> DataFrame:
    """(path, reason) of files that can't be a document: they lie in no source's folder, or hold nothing but white space."""
    below = F.regexp_replace("path", "^.*?" + root.rstrip("/").split("/")[-1] + "/", "")
    reason = F.when(~F.contains(below, F.lit("/")), "no source folder").when(F.trim(F.regexp_replace(F.coalesce("raw", F.lit("")), r"\s+", " ")) == "", "empty")
    return files.select("path", reason.alias("reason")).where("reason IS NOT NULL")


def documents(spark: SparkSession, root: str) -> DataFrame:
    files = read_files(spark, root)
    return parse(files.join(misplaced(files, root).where("reason = 'no source folder'").select("path"), "path", "left_anti"), root)


def run(spark: SparkSession, root: str, to: str) -> tuple[DataFrame, DataFrame]:
    """Write the documents by source, the statistics as JSON and what was left out; gives (statistics, left out)."""
    write(documents(spark, root), f"{to}/documents")
    docs = spark.read.schema(documents(spark, root).schema).parquet(f"{to}/documents")
    as_json(statistics(docs), f"{to}/statistics")
    as_json(misplaced(read_files(spark, root), root), f"{to}/left_out")
    return statistics(docs), spark.read.schema("path string, reason string").json(f"{to}/left_out")


def as_json(df: DataFrame, path: str) -> None:
    """A table as JSON lines."""
    df.write.mode("overwrite").json(path)


def scan(spark: SparkSession, root: str, sources: list[str] | None = None, skip: int = 0, limit: int | None = None, longest: int | None = None) -> DataFrame:
    """Documents that ``write`` left under ``root``, of the named sources: a missing one gives no rows.

    ``skip`` and ``limit`` count each source's documents in the order of their ids; ``longest`` cuts bodies.
    """
    docs = spark.read.parquet(root)
    if sources is not None:
        docs = docs.where(F.col("source").isin(sources))
    if skip or limit is not None:
        at = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
        last = F.lit(True) if limit is None else F.col("at") <= skip + limit
        docs = docs.withColumn("at", at).where((F.col("at") > skip) & last).drop("at")
    return docs if longest is None else docs.withColumn("body", F.substring("body", 1, longest))


def json_rows(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of JSON-lines files: blank lines are skipped, a missing field is null, and a line that is no JSON is a row of nulls."""
    lines = spark.read.text(paths).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def write(docs: DataFrame, path: str) -> None:
    """Parquet by source; a rewritten source replaces its own partition only."""
    docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def statistics(docs: DataFrame) -> DataFrame:
    """For each source and in total (source null): documents, and how many have or hold what."""
    counts = [F.sum(F.size(c)).alias(c) for c in ("emails", "speakers", "mentions", "channels", "attendees", "bots")]
    filled = [F.sum((F.col(c) != "").cast("bigint")).alias(c) for c in ("ticket_key", "date", "thread_id")]
    return docs.rollup("source").agg(F.count("*").alias("documents"), *counts, *filled)
