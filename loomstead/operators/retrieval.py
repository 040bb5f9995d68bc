"""Retrieval over an inverted index: document-frequency filtered BM25, scoped ranking, passages and metadata reranking.

Questions are a table (qid, question). A question's terms are filtered through document frequencies before they meet the
postings, so common words never read theirs. A compound (``audit-log``, ``p99.9``) is one term of a question: it stands in a
document where its parts stand one behind another. With ``stems`` terms are compared by Porter's stems, which are looked up
once for each distinct term.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.porter import stemmed
from ..functions.text import extract_all, tokens
from ..sources.store import bounded, ship
from .arbitrate import rounded

# BM25 as published, column weights, and limits of term selection.
K1, B = 1.2, 0.75
TITLE_WEIGHT, BODY_WEIGHT, FACET_WEIGHT = 4, 1, 2
MOST_COMMON, FEWEST_TERMS, SCOPE_TERMS = 0.05, 4, 6
WINDOW, STEP = 520, 260
IDF_FLOOR = 1e-6
#: So many terms are looked for at once as a list, more by a join. Rows of a batch that goes back from Python.
MOST_LISTED, ROWS_OUT = 1000, 20_000
COMPOUND = r"[a-z0-9_]+(?:[.\-/][a-z0-9_]+)*"
QUESTION_WORDS = [
    "a", "about", "an", "are", "decide", "decided", "did", "do", "does", "how", "is", "me", "of", "please", "said", "say", "tell", "the", "was", "were", "what", "when", "where", "which", "who", "why",
]


def split_up(docs: DataFrame) -> DataFrame:
    """(doc_id, t, b, f): the tokens of title, body and facets."""
    return docs.select("doc_id", *[tokens(F.col(c)).alias(a) for c, a in (("title", "t"), ("body", "b"), ("facets", "f"))])


def once(docs: DataFrame) -> bool:
    """Whether each document is one row, so that all its terms are met in one place."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def postings(docs: DataFrame, stems: bool = False, of: DataFrame | None = None, single: bool | None = None) -> DataFrame:
    """(term, doc_id, tf, len) of documents (doc_id, title, body, facets), tf weighted by column; only the terms ``of`` (term, ...) if given.

    Other terms are left where they stand, so only rows that are asked for are dealt out, once. A document's length is known
    in its own row; ``single``: whether all documents are one row, if the caller knows.
    """
    own = split_up(docs).withColumn("len", (F.size("t") + F.size("b") + F.size("f")).cast("bigint"))
    parts = F.array(*[F.struct(F.lit(w).alias("w"), F.col(c).alias("words")) for c, w in (("t", TITLE_WEIGHT), ("b", BODY_WEIGHT), ("f", FACET_WEIGHT))])
    flat = own.select("doc_id", "len", F.inline(parts)).select("doc_id", "len", "w", F.explode("words").alias("term"))
    if of is not None and not stems:
        flat = flat.join(bounded(of.select("term").distinct()), "term", "left_semi")
    if not (once(docs) if single is None else single):
        flat = flat.drop("len").join(own.groupBy("doc_id").agg(F.sum("len").alias("len")), "doc_id")
    tf = flat.groupBy("doc_id", "term").agg(F.sum("w").alias("tf"), F.first("len").alias("len"))
    if stems:
        tf = by_stem(tf).groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"), F.first("len").alias("len"))
    return tf.select("term", "doc_id", "tf", "len")


def frequencies(docs: DataFrame, of: DataFrame | None = None, single: bool | None = None) -> DataFrame:
    """(term, df) straight from documents: in how many each term stands, of all or of the terms ``of``."""
    single = once(docs) if single is None else single
    rows = split_up(docs).select("doc_id", F.explode(F.array_distinct(F.concat("t", "b", "f"))).alias("term"))
    if of is not None:
        rows = rows.join(bounded(of.select("term").distinct()), "term", "left_semi")
    return document_frequency(rows if single else rows.distinct())


def mean_length(docs: DataFrame) -> float | None:
    """Tokens of a document that has any, on average."""
    sizes = split_up(docs).select("doc_id", (F.size("t") + F.size("b") + F.size("f")).cast("bigint").alias("len"))
    return sizes.agg(F.sum("len") / F.count_distinct(F.when(F.col("len") > 0, F.col("doc_id")))).first()[0]


def by_stem(rows: DataFrame) -> DataFrame:
    """``rows`` with each term replaced by its stem."""
    return rows.join(stemmed(rows), "term").drop("term").withColumnRenamed("stem", "term")


def compound_parts(terms: DataFrame) -> DataFrame:
    """(term, parts) of the compounds among ``terms`` (term)."""
    return terms.select("term").distinct().withColumn("parts", tokens(F.col("term"))).where(F.size("parts") > 1)


def compound_postings(terms: DataFrame, found: DataFrame, docs: DataFrame, df: DataFrame | None = None, single: bool | None = None) -> DataFrame:
    """(term, doc_id, tf, len) of compounds among ``terms`` (term): only documents with the compound's rarest part are looked into.

    Up to ``MOST_LISTED`` parts are met in the documents as they are read; more by the postings ``found``.
    """
    parts = compound_parts(terms)
    each = parts.select("term", F.explode("parts").alias("part"))
    if df is None:
        df = document_frequency(found.join(bounded(each.select(F.col("part").alias("term")).distinct()), "term", "left_semi"))
    rarest = each.join(df.withColumnRenamed("term", "part"), "part").groupBy("term").agg(F.min_by("part", F.struct("df", "part")).alias("part"))
    rarest = bounded(rarest.join(parts, "term"))
    listed = [r[0] for r in rarest.select("part").distinct().limit(MOST_LISTED + 1).collect()]
    single = once(docs) if single is None else single
    if len(listed) <= MOST_LISTED and single:
        here = F.array_intersect(F.concat("t", "b", "f"), F.array(*map(F.lit, listed)).cast("array<string>"))
        near = split_up(docs).withColumn("len", (F.size("t") + F.size("b") + F.size("f")).cast("bigint")).withColumn("part", F.explode(here)).join(rarest, "part")
    else:
        near = rarest.join(found.select(F.col("term").alias("part"), "doc_id", "len"), "part").join(split_up(docs), "doc_id")
    text = lambda c: F.concat(F.lit(" "), F.array_join(c, "  "), F.lit(" "))
    tf = sum(w * occurrences(text(c), text("parts")) for c, w in (("t", TITLE_WEIGHT), ("b", BODY_WEIGHT), ("f", FACET_WEIGHT)))
    return near.select("term", "doc_id", tf.cast("bigint").alias("tf"), "len").where("tf > 0")


def query_terms(questions: DataFrame) -> DataFrame:
    """(qid, term): a question's terms of two characters or more, compounds whole."""
    return questions.select("qid", F.explode(F.array_distinct(extract_all(F.lower("question"), COMPOUND))).alias("term")).where(F.length("term") >= 2)


def muted(terms: DataFrame, phrases: DataFrame | None) -> DataFrame:
    """Terms without those of the phrases (qid, phrase): the words of the person asked about aren't the topic."""
    if phrases is None:
        return terms
    return terms.join(query_terms(phrases.select("qid", F.col("phrase").alias("question"))).distinct(), ["qid", "term"], "left_anti")


def document_frequency(found: DataFrame) -> DataFrame:
    return found.groupBy("term").agg(F.count("*").alias("df"))


def question_terms(questions: DataFrame) -> DataFrame:
    return questions.select("qid", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term")).where(F.length("term") >= 2)


def selected(known: DataFrame, documents: int) -> DataFrame:
    """Of (qid, term, df): terms in at most MOST_COMMON of the documents; where those are too few, the rarest that occur."""
    known = known.withColumn("ok", F.col("df") <= F.lit(MOST_COMMON * documents))
    own = Window.partitionBy("qid")
    known = known.withColumn("many", F.sum(F.col("ok").cast("int")).over(own)).withColumn("place", F.row_number().over(own.orderBy("df", "term")))
    return known.where(F.when(F.col("many") >= FEWEST_TERMS, F.col("ok")).otherwise(F.col("place") <= FEWEST_TERMS)).select("qid", "term", "df")


def selective_terms(questions: DataFrame, df: DataFrame, documents: int, mute: DataFrame | None = None) -> DataFrame:
    """(qid, term, df) of the plain terms worth a search; those of ``mute`` (qid, phrase) go before the choice."""
    return selected(muted(question_terms(questions), mute).join(df, "term"), documents)


def topic_terms(terms: DataFrame, df: DataFrame, mute: DataFrame | None = None) -> DataFrame:
    """(qid, term, df) of terms (qid, term) that occur, however often: for ranking within a scope."""
    return muted(terms, mute).where(~F.col("term").isin(QUESTION_WORDS)).join(df, "term").select("qid", "term", "df")


def match_count(terms: DataFrame, found: DataFrame) -> DataFrame:
    return terms.join(found, "term").groupBy("qid").agg(F.count_distinct("doc_id").alias("matches"))


def bm25_scores(terms: DataFrame, found: DataFrame, documents: int, mean_length: float) -> DataFrame:
    """(qid, doc_id, score) of every document with a term of the question (qid, term, df), rounded to 4 places."""
    tf, n = F.col("tf").cast("double"), F.lit(float(documents))
    idf = F.greatest(F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    part = idf * (tf * (K1 + 1.0)) / (tf + K1 * ((1.0 - B) + B * F.col("len") / F.lit(mean_length)))
    return terms.join(found, "term").select("qid", "doc_id", part.alias("part")).groupBy("qid", "doc_id").agg(rounded(F.sum("part")).alias("score"))


def bm25(terms: DataFrame, found: DataFrame, documents: int, mean_length: float, k: int, also: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """The ``k`` best documents of each question: (qid, rank, doc_id, score), ties by doc_id.

    ``also`` (qid, term, df) are terms of whom a question names: where a question has both kinds, a document must have one of
    each, and all count; where it has one kind, that. ``docs`` (qid, doc_id or doc_id) limits what may be found.
    """
    every = terms if also is None else terms.union(also.select("qid", "term", "df")).dropDuplicates(["qid", "term"])
    scored = bm25_scores(every, found, documents, mean_length)
    if docs is not None:
        scored = scored.join(docs, [c for c in ("qid", "doc_id") if c in docs.columns], "left_semi")
    if also is not None:
        hit = lambda t: t.join(found, "term").select("qid", "doc_id").distinct()
        both = terms.select("qid").distinct().intersect(also.select("qid").distinct())
        pairs = hit(terms.join(both, "qid", "left_semi")).intersect(hit(also.join(both, "qid", "left_semi")))
        scored = scored.join(both, "qid", "left_anti").unionByName(scored.join(pairs, ["qid", "doc_id"], "left_semi"))
    return top(scored, k)


def top(scored: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k)


def occurrences(text: Column, term: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("bigint")


def of_scope(docs: DataFrame, scope: DataFrame) -> DataFrame:
    """Documents of a scope (qid, doc_id), or (qid, source) for whole sources, a row for each question."""
    return docs.join(bounded(scope), [c for c in ("doc_id", "source") if c in scope.columns])


def scoped_rank(terms: DataFrame, docs: DataFrame, scope: DataFrame, k: int) -> DataFrame:
    """Rank the documents of a scope (qid, doc_id or source) by raw substring counts of the question's rarest terms: coverage, then weight."""
    rare = Window.partitionBy("qid").orderBy("df", "term")
    few = bounded(terms.withColumn("place", F.row_number().over(rare)).where(F.col("place") <= SCOPE_TERMS).drop("place"))
    low = of_scope(docs.select("doc_id", *[c for c in ("source",) if c in scope.columns], F.lower("title").alias("t"), F.lower("body").alias("b")), scope).select("qid", "doc_id", "t", "b")
    hit = low.join(few, "qid").select("qid", "doc_id", "df", occurrences(F.col("t"), F.col("term")).alias("t"), F.least(occurrences(F.col("b"), F.col("term")), F.lit(8)).alias("b")).where("t + b > 0")
    scored = hit.groupBy("qid", "doc_id").agg(F.count("*").alias("coverage"), rounded(F.sum((4 * F.col("t") + F.col("b")) / F.ln(2.0 + F.col("df")))).alias("weight"))
    best = Window.partitionBy("qid").orderBy(F.desc("coverage"), F.desc("weight"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k)


def weighed_windows(body: str, asked: list[tuple[object, list[str]]]) -> list[tuple[object, int, float, int]]:
    """(qid, start, score, terms) of a body's windows for each of its questions (qid, terms). A term is looked for once: where it stands, up to WINDOW / STEP windows hold it."""
    at: dict[str, tuple[float, list[int]]] = {}
    for term in {t for _, terms in asked for t in terms}:
        starts, place = [], body.find(term)
        while place >= 0 and len(term) <= WINDOW:
            first = max(0, -((WINDOW - place - len(term)) // STEP) * STEP)
            starts += [s for s in range(first, place + 1, STEP) if not starts or s > starts[-1]]
            place = body.find(term, place + 1)
        if starts:
            at[term] = (1 / math.sqrt(body.count(term)), starts)
    out = []
    for qid, terms in asked:
        sums: dict[int, list[float]] = {}
        for weight, starts in (at[t] for t in terms if t in at):
            for s in starts:
                sums.setdefault(s, []).append(weight)
        out += [(qid, s, math.floor(sum(w) * 1e4 + 0.5) / 1e4, len(w)) for s, w in sums.items()]
    return out


def passage_windows(docs: DataFrame, scope: DataFrame, terms: DataFrame) -> DataFrame:
    """Windows of WINDOW characters every STEP of a scope's (qid, doc_id or source) bodies, scored by 1 / sqrt(how often the body has the term) for each term in them.

    A body meets all its questions at once and is read once for each of their terms, whatever the number of its windows.
    """
    on = [c for c in ("doc_id", "source") if c in scope.columns]
    own = terms.groupBy("qid").agg(F.collect_list("term").alias("terms"))
    asked = bounded(scope.join(own, "qid").groupBy(*on).agg(F.collect_list(F.struct("qid", "terms")).alias("asked")))
    rows = docs.select("doc_id", *[c for c in on if c != "doc_id"], F.lower("body").alias("b")).where("b <> ''").join(asked, on).select("doc_id", "b", "asked")
    kinds = dict(terms.dtypes) | dict(docs.dtypes)
    ship(docs.sparkSession)

    def weigh(batches):
        for batch in batches:
            done = []
            for doc, body, asked in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                done += [(q, doc, *rest) for q, *rest in weighed_windows(body, [(a["qid"], a["terms"]) for a in asked])]
                if len(done) >= ROWS_OUT:
                    yield _batch(done)
                    done = []
            if done:
                yield _batch(done)

    return rows.mapInArrow(weigh, f"qid {kinds['qid']}, doc_id {kinds['doc_id']}, start int, score double, terms bigint")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (None, None, pa.int32(), pa.float64(), pa.int64())
    arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["qid", "doc_id", "start", "score", "terms"])


def rerank(ranked: DataFrame, facets: DataFrame, questions: DataFrame, weight: float = 1.0) -> DataFrame:
    """Blend each candidate's share of the best score with the share of the question's tokens that its facets (doc_id, text) have."""
    asked = questions.select("qid", F.array_distinct(tokens(F.col("question"))).alias("asked"))
    ranked = bounded(ranked)
    own = facets.join(bounded(ranked.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", tokens(F.col("text")).alias("own"))
    both = ranked.join(asked, "qid").join(own, "doc_id", "left")
    best = F.max("score").over(Window.partitionBy("qid"))
    share = F.coalesce(F.size(F.array_intersect("asked", "own")) / F.size("asked"), F.lit(0.0))
    blend = rounded(F.when(best > 0, F.col("score") / best).otherwise(1.0) + weight * share)
    place = Window.partitionBy("qid").orderBy(F.desc("blend"), "rank")
    return both.withColumn("blend", blend).withColumn("new_rank", F.row_number().over(place).cast("bigint")).select("qid", "doc_id", "blend", "new_rank")


def hits(ranked: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Whether an expected document (qid, doc_id) is among the first ``k``."""
    good = ranked.where(F.col("rank") <= k).join(expected, ["qid", "doc_id"], "left_semi").select("qid").distinct().withColumn("hit", F.lit(1))
    return expected.select("qid").distinct().join(good, "qid", "left").select("qid", F.coalesce("hit", F.lit(0)).cast("bigint").alias("hit"))


def stratified(rows: DataFrame, kind: str, each: int, key: str) -> DataFrame:
    """The first ``each`` rows of each kind, in the order of the key."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(kind).orderBy(key))).where(F.col("n") <= each).drop("n")


def quota(rows: DataFrame, order: list[str], each: int, limit: int) -> DataFrame:
    """(key, source, date, doc_id) picked in turns over the sources in ``order``: at most ``each`` of a source and ``limit`` of a key, undated last."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    own = rows.withColumn("place", place).where("place > 0")
    dated = F.when(F.col("date") == "", F.lit("9999")).otherwise(F.col("date"))
    own = own.withColumn("turn", F.row_number().over(Window.partitionBy("key", "source").orderBy(dated, "doc_id"))).where(F.col("turn") <= each)
    return own.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("turn", "place")).cast("bigint")).where(F.col("n") <= limit).select("key", "n", "source", "doc_id")
