"""What a document's source recorded about it: facet rows, cards, containers and how a question names them, reranking.

Documents are those of the intake: folders, channels, speakers, attendees (name, org), named_emails (name, email), headers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import content_words, slugs, stem
from ..functions.text import derived_date
from ..sources.store import bounded
from .arbitrate import rounded
from .questions import source_hint

# Header fields by use, what a source calls its containers, and lengths of cards.
INDEXED_HEADERS = ["from", "to", "cc", "subject", "attachments"]
RERANK_HEADERS = ["from", "to", "subject", "attachments"]
CARD_HEADERS = ["from", "to", "cc", "subject", "date"]
CONTAINER_LABEL = {
    "confluence": "space", "slack": "channel", "google_drive": "drive folder", "gmail": "mailbox folder", "linear": "project", "jira": "project", "github": "repo area", "fireflies": "folder",
    "hubspot": "record group",
}
LISTED, HEADER_CHARS, ROW_CHARS, CONTAINERS_SHOWN, PEOPLE_SHOWN, PAIRS_SHOWN = 8, 240, 200, 4, 10, 8
FEWEST_DOCUMENTS, WEIGHT = 2, 1.0


def clean_names(names: Column) -> Column:
    """Names of containers: trimmed, lowered, without leading #, each once; single characters and numbers are none."""
    low = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.regexp_replace(F.lower(F.trim(n)), "^#+", ""))
    return F.array_distinct(F.filter(low, lambda n: (F.length(n) >= 2) & ~n.rlike("^[0-9]+$")))


def strings(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda v: v != ""))


def participants(named: Column) -> Column:
    """(name, email) pairs, trimmed, each once, none empty on both sides."""
    pairs = F.transform(named, lambda p: F.struct(F.trim(F.coalesce(p["name"], F.lit(""))).alias("name"), F.trim(F.coalesce(p["email"], F.lit(""))).alias("email")))
    return F.array_distinct(F.filter(pairs, lambda p: (p["name"] != "") | (p["email"] != "")))


def facet_rows(docs: DataFrame) -> DataFrame:
    """One row of recorded metadata for each document."""
    attendees = F.transform("attendees", lambda a: a["name"])
    return docs.select(
        "doc_id", "source", "title", derived_date(F.col("date"), F.col("body")).alias("date"), "ticket_key", "thread_id", "slug",
        F.array_distinct(F.concat(clean_names(F.col("folders")), clean_names(F.col("channels")))).alias("containers"), strings(F.col("speakers")).alias("speakers"),
        strings(attendees).alias("attendees"), participants(F.col("named_emails")).alias("participants"), F.map_filter("headers", lambda _, v: v != "").alias("headers"),
    )


def memberships(docs: DataFrame) -> DataFrame:
    """(source, kind, name, key, doc_id) of every container that a document sits in."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), clean_names(F.col(c)).alias("names")) for k, c in (("folder", "folders"), ("channel", "channels"))])
    rows = docs.select("doc_id", "source", F.inline(kinds)).select("doc_id", "source", "kind", F.explode("names").alias("name"))
    return rows.select("source", "kind", "name", F.concat_ws(":", "source", "kind", "name").alias("key"), "doc_id")


def facet_text(docs: DataFrame) -> DataFrame:
    """(doc_id, facets): the filing details as one searchable text."""
    return docs.select("doc_id", facets_of().alias("facets"))


def facets_of() -> Column:
    parts = [F.col("slug"), *(F.array_join(c, " ") for c in ("folders", "channels", "speakers")), F.array_join(F.transform("attendees", lambda a: a["name"]), " ")]
    heads = [F.element_at("headers", h) for h in INDEXED_HEADERS]
    return F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in [*parts, *heads]))


def document_text(title: Column, body: Column) -> Column:
    return F.when(title != "", F.concat(title, F.lit("\n\n"), body)).otherwise(body)


def facets_for(facets: DataFrame, ids: DataFrame) -> DataFrame:
    return facets.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def all_containers(found: DataFrame, limit: int | None = None) -> DataFrame:
    """Containers, the largest first."""
    ordered = found.orderBy(F.desc("documents"), "key")
    return ordered if limit is None else ordered.limit(limit)


def counts(facets: DataFrame, found: DataFrame) -> DataFrame:
    """(what, n): documents and containers."""
    return facets.agg(F.count("*").alias("n")).select(F.lit("documents").alias("what"), "n").union(found.agg(F.count("*").alias("n")).select(F.lit("containers"), "n"))


def nameable(kind: Column, source: Column, documents: Column) -> Column:
    """Whether a question may open a container: a folder or a chat's channel, of two documents or more."""
    return ((kind == "folder") | (source == "slack")) & (documents >= FEWEST_DOCUMENTS)


def spoken_together(question: Column, name: Column) -> Column:
    """Whether some run of the question's words has, as a set, the name's words."""
    n, want = F.size(name), F.array_sort(F.array_distinct(name))
    starts = F.sequence(F.lit(1), F.size(question) - n + 1)
    return F.when((n > 0) & (F.size(question) >= n), F.exists(starts, lambda i: F.array_sort(F.array_distinct(F.slice(question, i, n))) == want)).otherwise(F.lit(False))


def container_words(found: DataFrame) -> DataFrame:
    return found.select("key", F.explode(F.array_distinct(content_words(F.col("name")))).alias("token"))


def containers_named(found: DataFrame, questions: DataFrame, limit: int = 4) -> DataFrame:
    """(qid, rank, key, source, tokens, documents): the containers that each question (qid, question) speaks of, the best first.

    All words of the name are in the question, together; two at least, unless the name is typed as it is written. A mailbox
    counts only if the question speaks of mail. More words come first, then the hinted source, then the smaller container.
    """
    said = questions.select("qid", content_words(F.col("question")).alias("said"), slugs(F.col("question")).alias("typed"), source_hint(F.col("question")).alias("hint"))
    by_word = said.select("qid", F.explode(F.array_distinct("said")).alias("token")).join(container_words(found), "token")
    by_word = by_word.groupBy("qid", "key").agg(F.count("*").alias("n")).where("n >= 2").select("qid", "key")
    by_slug = said.select("qid", F.explode("typed").alias("name")).join(found.select("name", "key"), "name").select("qid", "key")
    rows = by_word.union(by_slug).distinct().join(found.where(nameable(F.col("kind"), F.col("source"), F.col("documents"))), "key").join(said, "qid")
    rows = rows.withColumn("own", F.array_distinct(content_words(F.col("name")))).withColumn("slug", F.array_contains("typed", F.col("name")))
    ok = (F.size("own") > 0) & (F.size(F.array_except("own", "said")) == 0) & (F.col("slug") | (F.size("own") >= 2) & spoken_together(F.col("said"), F.col("own")))
    mailbox = (F.col("source") == "gmail") & (F.col("kind") == "folder") & ~F.coalesce(F.col("hint") == "gmail", F.lit(False))
    hinted = F.when(F.col("source") == F.col("hint"), 0).otherwise(1)
    place = Window.partitionBy("qid").orderBy(F.desc(F.size("own")), hinted, "documents", "key")
    ranked = rows.where(ok & ~mailbox).withColumn("rank", F.row_number().over(place).cast("bigint")).where(F.col("rank") <= limit)
    return ranked.select("qid", "rank", "key", "source", F.size("own").cast("bigint").alias("tokens"), "documents")


def hinted_only(named: DataFrame, questions: DataFrame) -> DataFrame:
    """Of the named containers, those of the source that a question points to; all where it points to none."""
    hints = questions.select("qid", source_hint(F.col("question")).alias("hint"))
    return named.join(hints, "qid").where(F.col("hint").isNull() | (F.col("source") == F.col("hint"))).drop("hint")


def facet_words(facets: DataFrame) -> DataFrame:
    """(doc_id, own): the stems of all that is recorded of a document."""
    heads = [F.element_at("headers", h) for h in RERANK_HEADERS]
    text = F.concat_ws(" ", "slug", "title", "ticket_key", *(F.array_join(c, " ") for c in ("containers", "speakers", "attendees")), *heads)
    return facets.select("doc_id", F.array_distinct(F.transform(content_words(text), stem)).alias("own"))


def rerank(ranked: DataFrame, words: DataFrame, questions: DataFrame, limit: int, weight: float = WEIGHT) -> DataFrame:
    """(qid, rank, doc_id, blend) of (qid, rank, doc_id, score): each candidate's share of the page's best score plus the share of the question's words that its facets (doc_id, own) have."""
    asked = questions.select("qid", F.array_distinct(F.transform(content_words(F.col("question")), stem)).alias("asked"))
    ranked = bounded(ranked)
    words = words.join(bounded(ranked.select("doc_id").distinct()), "doc_id", "left_semi")
    both = ranked.join(asked, "qid").join(words, "doc_id", "left")
    best = F.max("score").over(Window.partitionBy("qid"))
    share = F.when(F.size("asked") > 0, F.coalesce(F.size(F.array_intersect("asked", "own")) / F.size("asked"), F.lit(0.0))).otherwise(0.0)
    blend = rounded(F.when(best > 0, F.col("score") / best).otherwise(F.col("score")) + weight * share)
    place = Window.partitionBy("qid").orderBy(F.desc("blend"), "rank")
    rows = both.withColumn("blend", blend).withColumn("new", F.row_number().over(place).cast("bigint")).where(F.col("new") <= limit)
    return rows.select("qid", F.col("new").alias("rank"), "doc_id", "blend")


def _listed(values: Column, most: int, more: bool) -> Column:
    shown = F.slice(values, 1, most)
    if more:
        shown = F.when(F.size(values) > most, F.concat(shown, F.array(F.concat(F.lit("+"), F.size(values) - most, F.lit(" more"))))).otherwise(shown)
    return F.array_join(shown, ", ")


def _people(pairs: Column, most: int) -> Column:
    said = lambda p: F.when(p["name"] == "", p["email"]).when(p["email"] == "", p["name"]).otherwise(F.concat(p["name"], F.lit(" <"), p["email"], F.lit(">")))
    return F.array_join(F.slice(F.transform(pairs, said), 1, most), ", ")


def _lines(rows: list[tuple[Column, Column]], mark: str, longest: int | None) -> Column:
    """'label: value' for each value that isn't empty, one a line."""
    cut = lambda v: v if longest is None else F.trim(F.left(v, F.lit(longest)))
    return F.concat_ws("\n", *(F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(mark), label, F.lit(": "), cut(v))) for label, v in rows))


def card(facets: DataFrame) -> DataFrame:
    """(doc_id, card): the recorded fields as a text, lists cut to ``LISTED`` with how many more there are."""
    head = lambda h: F.left(F.trim(F.element_at("headers", h)), F.lit(HEADER_CHARS))
    rows = [(F.lit("source"), F.col("source")), *((F.lit(c), _listed(F.col(c), LISTED, True)) for c in ("containers", "speakers", "attendees"))]
    rows += [(F.lit("participants"), _people(F.col("participants"), LISTED)), *((F.lit(h), head(h)) for h in CARD_HEADERS)]
    rows += [(F.lit("date"), F.when(F.coalesce(head("date"), F.lit("")) == "", F.col("date"))), (F.lit("ticket"), F.col("ticket_key")), (F.lit("thread"), F.col("thread_id")), (F.lit("slug"), F.col("slug"))]
    return facets.select("doc_id", _lines(rows, "", None).alias("card"))


def metadata_card(facets: DataFrame) -> DataFrame:
    """(doc_id, card): the fields as a block for a prompt, containers under the name that their source has for them."""
    label = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in CONTAINER_LABEL.items() for x in kv)), F.col("source")), F.lit("folder"))
    label = F.when(F.size("containers") == 1, label).otherwise(F.concat(label, F.lit("s")))
    names = F.when(F.col("source") == "slack", F.transform("containers", lambda c: F.when(c.startswith("#"), c).otherwise(F.concat(F.lit("#"), c)))).otherwise(F.col("containers"))
    rows = [(F.lit("source"), F.col("source")), (label, _listed(names, CONTAINERS_SHOWN, False)), (F.lit("ticket"), F.col("ticket_key")), (F.lit("date"), F.col("date"))]
    rows += [(F.lit(h), F.element_at("headers", h)) for h in INDEXED_HEADERS]
    other = F.array_sort(F.filter(F.map_keys("headers"), lambda k: ~k.isin([*INDEXED_HEADERS, "date"])))
    others = F.array_join(F.transform(other, lambda k: F.concat(F.lit("  "), k, F.lit(": "), F.trim(F.left(F.element_at("headers", k), F.lit(ROW_CHARS))))), "\n")
    people = [(F.lit(c), _listed(F.col(c), PEOPLE_SHOWN, False)) for c in ("speakers", "attendees")]
    mailed = F.coalesce(F.element_at("headers", "from"), F.element_at("headers", "to")).isNotNull()
    named = F.filter("participants", lambda p: p["name"] != "")
    last = [(F.lit("participants"), F.when(~mailed, _people(named, PAIRS_SHOWN))), (F.lit("thread"), F.col("thread_id")), (F.lit("slug"), F.col("slug"))]
    text = F.concat_ws("\n", *(F.nullif(part, F.lit("")) for part in (_lines(rows, "  ", ROW_CHARS), others, _lines([*people, *last], "  ", ROW_CHARS))))
    return facets.select("doc_id", F.when(text != "", F.concat(F.lit("Metadata:\n"), text)).otherwise("").alias("card"))
