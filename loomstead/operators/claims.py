"""Claims from batches of documents through any extractor: its reply is parsed, validated, grounded and cached, and never trusted.

An extractor is a function from the passages of a batch (a list) to a JSON text {"claims": [{document, subject, predicate,
object_value, confidence}]}, ``document`` counting the passages from 1. What it says about provenance is overwritten from the
document; a claim whose value isn't in the passage is dropped. A reply that is no JSON is asked for once more and then counts
as not read: unlike a reply without claims it isn't cached, and the document stays on the list of what is to be done.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_date
from ..sources.store import ship

# Predicates and limits.
PREDICATES = ["owner", "status", "due_date", "limit", "reports_to"]
LONGEST_SUBJECT, LONGEST_VALUE, BATCH = 120, 200, 6
CLAIM = "struct<document:string,subject:string,predicate:string,object_value:string,confidence:string>"
ANSWERED = "doc_id string, source string, asserted_at string, scope string, passage string, key string, reply string"

RULES = [
    ("owner", re.compile(r"([A-Z][\w -]{1,60}?) is owned by ([A-Z][\w ]{1,40})")),
    ("reports_to", re.compile(r"([A-Z][\w]+(?: [A-Z]\w+)*) reports to ([A-Z]\w+(?: [A-Z]\w+)*)")),
    ("status", re.compile(r"([A-Z][\w-]{1,60}) status: (\w+)")),
    ("due_date", re.compile(r"([A-Z][\w-]{1,60}) due (\d{4}-\d{2}-\d{2})")),
    ("limit", re.compile(r"([A-Z][\w -]{1,60}?) limit (\d+ ?%)")),
]


def by_rules(passages: list[str]) -> str:
    """The offline extractor: a few fixed sentences."""
    found = [
        {"document": i, "subject": s, "predicate": p, "object_value": v.strip(), "confidence": 0.9}
        for i, passage in enumerate(passages, 1) for p, rule in RULES for s, v in rule.findall(passage)
    ]
    return json.dumps({"claims": found})


def flat(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def cache_key(version: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(version), "scope", "doc_id", "passage"), 256)


def claims_in(text: str | None) -> list[dict] | None:
    """The claims of a reply: what stands between its outermost braces; None if that is no JSON with a list of claims."""
    begin, end = (text or "").find("{"), (text or "").rfind("}")
    if begin < 0 or end <= begin:
        return None
    try:
        loaded = json.loads(text[begin : end + 1])
    except ValueError:
        return None
    found = loaded.get("claims") if isinstance(loaded, dict) else None
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else None


def asked(extractor: Callable[[list[str]], str], passages: list[str]) -> list[dict] | None:
    """The claims of a batch, with one more try where the reply is no JSON; None if that fails too, or the extractor does."""
    for _ in range(2):
        try:
            found = claims_in(extractor(passages))
        except Exception:  # noqa: BLE001  an outage must not end the job
            return None
        if found is not None:
            return found
    return None


def replies(passages: DataFrame, extractor: Callable[[list[str]], str], version: str, cached: DataFrame | None = None) -> DataFrame:
    """(key, reply, ...) of passages (doc_id, source, asserted_at, scope, passage): a JSON list of each document's own claims.

    Passages with a cached reply (key, reply) aren't asked again. The others go to the extractor in batches of ``BATCH`` of one
    scope. ``reply`` is null where a batch wasn't read; such rows are not for the cache.
    """
    ship(passages.sparkSession)
    plain = passages.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("doc_id", "source", "asserted_at", "scope", "passage")))
    keyed = plain.withColumn("key", cache_key(version))
    todo = keyed if cached is None else keyed.join(cached.where("reply IS NOT NULL").select("key"), "key", "left_anti").select(*keyed.columns)
    place = F.row_number().over(Window.partitionBy("scope").orderBy("doc_id", "key"))
    todo = todo.withColumn("batch", F.floor((place - 1) / BATCH))

    def read(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "key"])
        found = asked(extractor, group["passage"].tolist())
        own: list[list[dict]] = [[] for _ in range(len(group))]
        for claim in found or []:
            number = str(claim.get("document")).strip()
            if number.isdigit() and 1 <= int(number) <= len(group):
                own[int(number) - 1].append({k: v for k, v in claim.items() if isinstance(v, (str, int, float)) and not isinstance(v, bool)})
        return group.drop(columns="batch").assign(reply=None if found is None else [json.dumps(x) for x in own])

    fresh = todo.groupBy("scope", "batch").applyInPandas(read, ANSWERED)
    if cached is None:
        return fresh
    return keyed.join(cached.where("reply IS NOT NULL").select("key", "reply").dropDuplicates(["key"]), "key").select(*fresh.columns).unionByName(fresh)


def to_cache(answered: DataFrame) -> DataFrame:
    """(key, reply) of what was read, with or without claims."""
    return answered.where("reply IS NOT NULL").select("key", "reply").dropDuplicates(["key"])


def validated(answered: DataFrame) -> DataFrame:
    """Claims of replies: known predicate, sizes in bounds, confidence a number in [0, 1], value grounded in the passage."""
    rows = answered.select("doc_id", "source", "asserted_at", "scope", "passage", F.inline(F.from_json("reply", f"array<{CLAIM}>")))
    confidence = F.expr("try_cast(confidence AS double)")
    rows = rows.withColumn("subject", F.trim("subject")).withColumn("object_value", F.trim("object_value")).withColumn("extractor_confidence", F.when(confidence.between(0, 1), confidence))
    sizes = F.length("subject").between(1, LONGEST_SUBJECT) & F.length("object_value").between(1, LONGEST_VALUE)
    grounded = (flat(F.col("object_value")) != "") & F.contains(flat(F.col("passage")), flat(F.col("object_value")))
    ok = F.col("predicate").isin(PREDICATES) & sizes & F.col("extractor_confidence").isNotNull() & grounded
    claim_id = F.left(F.sha1(F.concat_ws("|", "doc_id", "predicate", flat(F.col("subject")), flat(F.col("object_value")))), F.lit(12))
    return rows.where(ok).select(
        claim_id.alias("claim_id"), "subject", "predicate", "object_value", "doc_id", "source", normal_date(F.col("asserted_at")).alias("asserted_at"), "extractor_confidence", "scope"
    ).dropDuplicates(["claim_id", "scope"])


def extract(passages: DataFrame, extractor: Callable[[list[str]], str] = by_rules, version: str = "1", cached: DataFrame | None = None) -> DataFrame:
    return validated(replies(passages, extractor, version, cached))


def scanned(answered: DataFrame) -> DataFrame:
    """(scope, doc_id, claims) of what was read: 0 claims is not the same as not read."""
    many = F.size(F.from_json("reply", f"array<{CLAIM}>")).cast("bigint")
    return answered.where("reply IS NOT NULL").select("scope", "doc_id", many.alias("claims"))


def to_scan(passages: DataFrame, done: DataFrame) -> DataFrame:
    """Passages whose (scope, doc_id) isn't done yet."""
    return passages.join(done.select("scope", "doc_id").distinct(), ["scope", "doc_id"], "left_anti").select(*passages.columns)


def extract_work_items(picked: DataFrame, docs: DataFrame, extractor: Callable[[list[str]], str] = by_rules, version: str = "1") -> DataFrame:
    """Claims of the documents picked for each work item (key, n, doc_id); the key is the scope. ``docs``: (doc_id, source, date, passage)."""
    rows = picked.select(F.col("key").alias("scope"), "doc_id").join(docs, "doc_id").select("doc_id", "source", F.col("date").alias("asserted_at"), "scope", "passage")
    return extract(rows, extractor, version)


def batches(items: list, size: int) -> Iterator[list]:
    for at in range(0, len(items), size):
        yield items[at : at + size]
