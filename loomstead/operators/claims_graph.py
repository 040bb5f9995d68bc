"""The graph of claims: claims, their evidence, whom they are about, and disagreements with their sides, as tables of one load.

``gen`` names the load; readers ask for one generation, so an older one never mixes in. Ids are the natural keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import bounded
from .arbitrate import GROUP, contradicts, disagreeing, disagreements, supersedes
from .graph import denoted_by

# Predicates whose value names a person, and lengths of texts on a vertex.
PERSON_VALUED = ["owner", "reports_to"]
TITLE_CHARS, RATIONALE_CHARS = 200, 500


def disagreement_key() -> Column:
    return F.concat_ws("|", *GROUP)


def people_named(claims: DataFrame, aliases: DataFrame) -> DataFrame:
    """(text, eid): subjects and values that are the form of exactly one entity."""
    texts = claims.select(F.col("subject").alias("text")).union(claims.where(F.col("predicate").isin(PERSON_VALUED)).select("object_value"))
    return denoted_by(texts, aliases).where("entities = 1").select("text", "eid")


def about(claims: DataFrame, people: DataFrame) -> DataFrame:
    """(claim_id, eid, predicate, and trust if known): the one person a claim is about, by its value if that names people, else by its subject. A claim is one row, a text of ``people`` too."""
    of = lambda c, name: people.select(F.col("text").alias(c), F.col("eid").alias(name))
    value = F.when(F.col("predicate").isin(PERSON_VALUED), F.lower(F.trim("object_value")))
    rows = claims.select("claim_id", "predicate", *(["trust"] if "trust" in claims.columns else []), F.lower(F.trim("subject")).alias("s"), value.alias("v"))
    rows = rows.join(of("v", "by_value"), "v", "left").join(of("s", "by_subject"), "s", "left")
    return rows.select("claim_id", F.coalesce("by_value", "by_subject").alias("eid"), *[c for c in rows.columns if c in ("predicate", "trust")]).where("eid IS NOT NULL")


def build(arbitrated: DataFrame, titles: DataFrame, aliases: DataFrame, gen: str, only: str | None = None) -> dict[str, DataFrame]:
    """The eight tables of a load from arbitrated claims, titles (doc_id, title) and aliases (surface, eid).

    ``only`` is the one table to make; whom the claims name is looked up at once, and only for tables that say it.
    """
    stamp = F.lit(gen).alias("gen")
    worded = disagreements(arbitrated, subjects=True)
    found = worded.drop("winner_subject", "runner_subject")
    over = disagreeing(arbitrated).withColumn("key", disagreement_key())
    titles = titles.groupBy("doc_id").agg(F.first("title").alias("title"))  # one title a document, so a reader without it needs no join
    claims = arbitrated.join(titles, "doc_id", "left").select(
        "claim_id", "scope", "subject", "predicate", "object_value", "doc_id", F.left(F.coalesce("title", F.lit("")), F.lit(TITLE_CHARS)).alias("title"), "source", "asserted_at", "extractor_confidence",
        "trust", "status", F.left(F.coalesce("rationale", F.lit("")), F.lit(RATIONALE_CHARS)).alias("rationale"), stamp)
    tables = {
        "claims": claims,
        "evidenced_by": arbitrated.select("claim_id", "doc_id", stamp),
        "contradicts": contradicts(over).select("*", stamp),
        "supersedes": supersedes(over).select("*", stamp),
        "over": over.select("key", "claim_id", F.col("value_rank").cast("bigint").alias("side"), "status", stamp),
    }
    if only in tables:
        return {only: tables[only]}
    people = bounded(people_named(arbitrated, aliases))
    # the first of winner's value, runner's value, winner's subject, runner's subject that names someone: a claim is about its value's person first
    sides = [F.struct(F.col(f"{s}_subject").alias("subject"), F.col(f"{s}_value").alias("object_value")) for s in ("winner", "runner")]
    ends = worded.select("key", "predicate", F.posexplode(F.array(*sides)).alias("side", "end")).select("key", "predicate", "side", "end.*")
    by_value = F.when(F.col("predicate").isin(PERSON_VALUED), F.lower(F.trim("object_value")))
    forms = F.array(F.struct(F.col("side").alias("at"), by_value.alias("text")), F.struct((F.col("side") + 2).alias("at"), F.lower(F.trim("subject")).alias("text")))
    named = ends.select("key", F.inline(forms)).join(people, "text").groupBy("key").agg(F.min_by("eid", "at").alias("eid"))
    return tables | {
        "about": about(arbitrated, people).select("claim_id", "eid", "predicate", "trust", stamp),
        "disagreements": found.join(named.withColumnRenamed("eid", "entity_eid"), "key", "left").withColumn("entity_eid", F.coalesce(F.col("entity_eid").cast("string"), F.lit(""))).select("*", stamp),
        "concerns": named.select("key", "eid", stamp),
    }


def in_generation(rows: DataFrame, gen: str) -> DataFrame:
    return rows.where(F.col("gen") == gen)


def _ranked(rows: DataFrame, by: str, limit: int | None) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("trust"), "other")).cast("bigint")
    ranked = rows.withColumn("place", place)
    return ranked if limit is None else ranked.where(F.col("place") <= limit)


def contradicted_by(edges: DataFrame, claims: DataFrame, limit: int | None = None) -> DataFrame:
    """(claim_id, place, other, trust): the claims against each claim, the most trusted first."""
    near = edges.select(F.col("src").alias("claim_id"), F.col("dst").alias("other")).join(claims.select(F.col("claim_id").alias("other"), "trust"), "other")
    return _ranked(near, "claim_id", limit).select("claim_id", "place", "other", "trust")


def claims_about(links: DataFrame, claims: DataFrame, limit: int | None = None) -> DataFrame:
    """(eid, place, other, trust, predicate): the claims about each person, the most trusted first."""
    near = links.withColumnRenamed("claim_id", "other")
    if "trust" not in links.columns:
        near = near.select("eid", "other").join(claims.select(F.col("claim_id").alias("other"), "trust", "predicate"), "other")
    return _ranked(near, "eid", limit).select("eid", "place", "other", "trust", "predicate")
