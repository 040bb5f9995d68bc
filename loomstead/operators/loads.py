"""Loads of the graph: entities with their aliases, who is named, speaks and writes in documents, surfaces; and what other programs ask for.

Documents are those of the intake, aliases (eid, kind, surface). Edges are resolved by a lookup that knows only unambiguous forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import norm_name
from .graph import existing, linked, mention_edges, unique_lookup
from .questions import surface_facts

# What a managed search takes of a document, and how long its text may be.
META = ["doc_id", "source", "title", "date", "ticket_key", "thread_id"]
LONGEST_TEXT = 200_000


def ontology(clustered: DataFrame, found: DataFrame, named: DataFrame, evidence: DataFrame) -> dict[str, DataFrame]:
    """Entity and alias vertices and RESOLVES_TO edges of clusters (key, entity), surfaces, canonical rows and best evidence (key, score, signals)."""
    aliases = found.join(clustered.select("key", "entity"), "key").join(named.select("entity", "eid"), "entity")
    sizes = aliases.groupBy("eid").agg(F.count("*").alias("alias_count"))
    return {
        "entities": named.join(sizes, "eid").select("eid", F.col("name").alias("canonical_name"), "confidence", "alias_count", "occurrences"),
        "aliases": aliases.select("key", F.col("value").alias("surface"), "kind", F.col("count").alias("occurrences")),
        "resolves_to": aliases.select("key", "eid").join(evidence.select("key", "score", "signals"), "key"),
    }


def structured_surfaces(docs: DataFrame, qualifiers: Column | None = None) -> DataFrame:
    """(doc_id, kind, surface) of all identity fields; chat handles are handles, whatever field they are in."""
    name = lambda v: norm_name(v, qualifiers)
    said = F.when(F.col("source") == "slack", "handle").otherwise("name")
    parts = [
        (F.lit("email"), F.transform("emails", lambda v: F.lower(F.trim(v)))), (F.lit("email"), F.transform("named_emails", lambda p: F.lower(F.trim(p["email"])))), (F.lit("name"), F.transform("named_emails", lambda p: name(p["name"]))),
        (said, F.transform("speakers", lambda v: F.when(F.col("source") == "slack", F.lower(v)).otherwise(name(v)))), (F.lit("handle"), F.transform("mentions", lambda v: F.lower(v))),
        (F.lit("name"), F.transform("attendees", lambda a: name(a["name"]))),
    ]
    rows = docs.select("doc_id", F.inline(F.array(*[F.struct(k.alias("kind"), v.alias("forms")) for k, v in parts])))
    return rows.select("doc_id", "kind", F.explode("forms").alias("surface")).where("surface <> ''")


def speaker_surfaces(docs: DataFrame, qualifiers: Column | None = None) -> DataFrame:
    chat = F.col("source") == "slack"
    rows = docs.select("doc_id", F.when(chat, "handle").otherwise("name").alias("kind"), F.explode("speakers").alias("v"), chat.alias("chat"))
    return rows.select("doc_id", "kind", F.when(F.col("chat"), F.lower("v")).otherwise(norm_name(F.col("v"), qualifiers)).alias("surface")).where("surface <> ''")


def sender_surfaces(docs: DataFrame, qualifiers: Column | None = None) -> DataFrame:
    """The address, then the name, of a mail's sender: 'Name <address>' or an address alone."""
    raw = F.coalesce(F.element_at("headers", "from"), F.lit(""))
    inside = F.regexp_extract(raw, r"<([^<>]*)>", 1)
    address = F.lower(F.trim(F.when(inside != "", inside).when(F.contains(raw, F.lit("@")), raw)))
    name = norm_name(F.regexp_replace(F.when(inside != "", F.regexp_replace(raw, r"<[^<>]*>", "")), '"', ""), qualifiers)
    kinds = F.array(F.struct(F.lit("email").alias("kind"), address.alias("surface")), F.struct(F.lit("name").alias("kind"), name.alias("surface")))
    return docs.select("doc_id", F.inline(kinds)).where("surface <> ''")


def edges(surfaces: DataFrame, aliases: DataFrame, functional: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, outcomes) of surfaces (doc_id, kind, surface): one edge for each entity and document with how often and by which kinds, and how many surfaces came to what."""
    if functional is not None:  # the mailboxes' entities
        mails = aliases.where("kind = 'email'").withColumn("local", F.substring_index(F.lower("surface"), "@", 1))
        functional = mails.join(functional.select("local").distinct(), "local", "left_semi").select("eid")
    found = linked(surfaces, unique_lookup(aliases.select("eid", "kind", "surface"), functional))
    return mention_edges(found.where("outcome = 'linked'").select("eid", "doc_id", "kind")), found.groupBy("outcome").agg(F.count("*").alias("surfaces"))


def document_graph(docs: DataFrame, aliases: DataFrame, entities: DataFrame, functional: DataFrame | None = None, qualifiers: Column | None = None) -> dict[str, DataFrame]:
    """Document vertices, MENTIONED_IN, SPOKE_IN and SENT edges between what exists (entities (eid)), and the outcomes of mentions."""
    mentioned, outcomes = edges(structured_surfaces(docs, qualifiers), aliases, functional)
    spoke, _ = edges(speaker_surfaces(docs, qualifiers), aliases, functional)
    sent, _ = edges(sender_surfaces(docs, qualifiers), aliases, functional)
    real = lambda df: existing(df.withColumnsRenamed({"eid": "src", "doc_id": "dst"}), entities.select("eid"), docs.select("doc_id")).withColumnsRenamed({"src": "eid", "dst": "doc_id"})
    return {"documents": docs.select("doc_id", "source", "title", "date"), "mentioned_in": real(mentioned), "spoke_in": real(spoke), "sent": real(sent), "outcomes": outcomes}


def surface_graph(aliases: DataFrame) -> dict[str, DataFrame]:
    """Surface vertices with what is known of each form, and DENOTES edges (text, eid, kinds, occurrences)."""
    low = aliases.withColumn("text", F.lower(F.trim("surface")))
    denotes = low.groupBy("text", "eid").agg(F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("kinds"), F.sum("occurrences").alias("occurrences"))
    return {"surfaces": surface_facts(aliases), "denotes": denotes}


def quoting(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, source, date, doc_id) of documents that quote a work item (key): as their own ticket, or letter for letter in title or body.

    Candidates come by the key's form in the text, so no document meets a key that it doesn't hold.
    """
    form = r"[A-Za-z]{2,10}-\d+"
    text = F.concat_ws(" ", "title", "body")
    held = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(form), F.lit(0)), lambda k: F.upper(k)))
    rows = docs.select("doc_id", "source", "date", F.explode(F.array_distinct(F.concat(held, F.filter(F.array("ticket_key"), lambda k: k != "")))).alias("key"))
    return rows.join(keys.select("key").where("key <> ''").distinct(), "key", "left_semi").select("key", "source", "date", "doc_id")


def uploads(docs: DataFrame) -> DataFrame:
    """What a managed search takes: the text, cut, and the recorded fields that aren't empty as a map."""
    meta = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, META)), F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in META))), lambda _, v: v != "")
    return docs.select("doc_id", F.left(F.concat_ws("\n\n", F.nullif("title", F.lit("")), "body"), F.lit(LONGEST_TEXT)).alias("text"), meta.alias("meta"))


def first_hits(hits: DataFrame) -> DataFrame:
    """Of (rank, doc_id, ...): each document where it comes first, in that order, ranked anew."""
    own = Window.partitionBy("doc_id").orderBy("rank")
    once = hits.withColumn("n", F.row_number().over(own)).where("n = 1").drop("n")
    return once.orderBy("rank")


def retrieval_report(ways: dict[str, DataFrame], expected: DataFrame, kinds: DataFrame, k: int) -> DataFrame:
    """(kind, questions, plain, identity, won, lost): by kind of question and in total (kind null), how many have an expected document among the first ``k`` in either way."""
    hit = lambda name: ways[name].where(F.col("rank") <= k).join(expected, ["qid", "doc_id"], "left_semi").select("qid").distinct().withColumn(name, F.lit(1))
    rows = kinds.join(expected.select("qid").distinct(), "qid", "left_semi").join(hit("plain"), "qid", "left").join(hit("identity"), "qid", "left").fillna(0)
    won, lost = F.sum((F.col("identity") > F.col("plain")).cast("bigint")), F.sum((F.col("identity") < F.col("plain")).cast("bigint"))
    sums = [F.sum(F.col(c).cast("bigint")).alias(c) for c in ("plain", "identity")]
    return rows.rollup("kind").agg(F.count("*").alias("questions"), *sums, won.alias("won"), lost.alias("lost"))
