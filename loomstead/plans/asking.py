"""Questions over parts and orders, and the queries of reading them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arbitrate as A
from ..operators import questions as Q
from . import corpus

ASKED = ["Which pages in the space mention red gear?", "Was the cold rod ticket on a call?", "Did the meeting and the email agree about old ring p95?", "What is in the inbox of blue bolt", "", "Old gear or red gear, per the repo"]
VALUES = ["resolved", "sup 1 is resolved", "not resolved", "20", "120", "20 units", "liam", "liam maria", "liam maria joe"]


def asked(spark):
    return spark.createDataFrame(list(enumerate(ASKED)), "qid bigint, question string")


def aliases(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    named = part.select(F.col("p_name").alias("surface"), F.lit("name").alias("kind"), F.col("p_name").alias("eid"))
    return named.union(part.select(F.substring_index("p_name", " ", 1), F.lit("handle"), F.col("p_name"))).union(part.select(F.col("p_name"), F.lit("handle"), F.when(F.length("p_name") % 4 == 0, F.col("p_brand")).otherwise(F.col("p_name"))))


def source_hints(spark, sf):
    return asked(spark).select("qid", Q.source_hint(F.col("question")).alias("hint"))


def phrase_windows(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    return items.select("item_id", F.posexplode(Q.phrases(Q.tokens(F.col("text"))))).select("item_id", F.col("pos").cast("bigint").alias("place"), F.col("col").alias("phrase"))


def surface_facts(spark, sf):
    return Q.surface_facts(aliases(spark, sf))


def read_identities(spark, sf):
    return Q.read_identities(asked(spark), aliases(spark, sf))


def spoken_names(spark, sf):
    """Names of parts that a question speaks, in any order of their words."""
    names = spark.read.parquet(f"{sf}/part.parquet").select(F.lower("p_name").alias("name")).distinct()
    words = names.select("name", F.explode(F.array_distinct(Q.tokens(F.col("name")))).alias("word"))
    said = asked(spark).select("qid", "question", F.explode(F.array_distinct(Q.tokens(F.col("question")))).alias("word"))
    return said.join(words, "word").select("qid", "question", "name").distinct().where(Q.spoken(F.col("question"), F.col("name"))).select("qid", "name")


def by_ids(spark, sf):
    want = spark.createDataFrame([(0, 7), (1, 3), (2, -5), (3, 7), (4, 1)], "place bigint, doc_id bigint")
    return Q.by_ids(want, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")).select("place", "doc_id", "source")


def united_context(spark, sf):
    """The best of BM25, then the best of the scope that isn't there yet."""
    i = corpus.Index(spark, sf)
    scoped = corpus.R.scoped_rank(i.terms, i.docs, i.scope(), 5)
    return Q.united(i.ranked(5), scoped)


def work_items(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").join(spark.read.parquet(f"{sf}/supplier.parquet"), F.col("l_suppkey") == F.col("s_suppkey"))
    return Q.work_items(lines.select(F.col("l_partkey").alias("key"), F.col("s_nationkey").alias("source"), F.col("l_orderkey").alias("doc_id")), 5)


def value_fold(spark, sf):
    return spark.createDataFrame([(VALUES,)], "v array<string>").select(F.explode(A.fold(F.col("v"))).alias("value", "stands_for"))


LISTED = ", ".join(f"({i}, '{q}')" for i, q in enumerate(ASKED))
NAMES = """WITH asked(qid, question) AS (VALUES """ + LISTED + r"""), al AS (SELECT lower(p_name) AS t, 'name' AS kind, p_name AS eid FROM part UNION ALL SELECT lower(split_part(p_name, ' ', 1)), 'handle', p_name FROM part
  UNION ALL SELECT lower(p_name), 'handle', CASE WHEN length(p_name) % 4 = 0 THEN p_brand ELSE p_name END FROM part), w AS (SELECT qid, regexp_extract_all(lower(question), '[\p{L}\p{N}]+') AS w FROM asked),
said AS (SELECT DISTINCT qid, unnest(list_concat(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]), list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), w)) AS phrase FROM w),
one AS (SELECT t, min(eid) AS eid FROM al GROUP BY t HAVING count(DISTINCT eid) = 1)
"""
QUERIES = {
    "source_hint": (source_hints, "SELECT * FROM (VALUES (0::BIGINT, 'confluence'), (1, NULL), (2, NULL), (3, 'gmail'), (4, NULL), (5, 'github')) v(qid, hint)"),
    "phrase_windows": (phrase_windows, r"""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark), p AS (SELECT item_id, list_concat(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]),
      list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), w) AS p FROM w) SELECT item_id, unnest(range(0, len(p))) AS place, unnest(p) AS phrase FROM p"""),
    "surface_facts": (surface_facts, NAMES + """, g AS (SELECT split_part(t, ' ', 1) AS t, count(DISTINCT t) AS n FROM al WHERE kind = 'name' AND contains(t, ' ') GROUP BY 1)
      SELECT t AS text, count(DISTINCT eid) AS entities, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kinds, coalesce(any_value(n), 0) AS given_name_forms FROM al LEFT JOIN g USING (t) GROUP BY t"""),
    "read_identities": (read_identities, NAMES + """SELECT qid, phrase, eid FROM (SELECT *, row_number() OVER (PARTITION BY qid, eid ORDER BY length(phrase) DESC, phrase) AS k FROM said JOIN one ON t = phrase
      WHERE regexp_matches(phrase, '[ @._0-9-]') AND NOT regexp_full_match(phrase, '[a-z]?[0-9]+[a-z]?')) WHERE k = 1"""),
    "spoken_names": (spoken_names, NAMES + "SELECT DISTINCT qid, lower(p_name) AS name FROM said, part WHERE phrase IN (lower(p_name), lower(split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)))"),
    "get_many": (by_ids, "SELECT place, doc_id, source FROM (VALUES (0::BIGINT, 7), (1, 3), (2, -5), (3, 7), (4, 1)) v(place, d) JOIN documents ON doc_id = d"),
    "united_context": (united_context, corpus.SQL + """, few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY df, term) AS place FROM t) WHERE place <= 6),
      h AS (SELECT qid, doc_id, df, (length(lower(title)) - length(replace(lower(title), term, ''))) // length(term) AS a, least((length(lower(body)) - length(replace(lower(body), term, ''))) // length(term), 8) AS b FROM c JOIN few ON source = 'src' || (qid % 20)),
      g AS (SELECT qid, doc_id, count(*) AS coverage, floor(sum((4 * a + b) / ln(2e0 + df)) * 1e4 + 0.5e0) / 1e4 AS weight FROM h WHERE a + b > 0 GROUP BY ALL),
      u AS (SELECT qid, doc_id, rank, 0 AS list FROM ranked WHERE rank <= 5 UNION ALL SELECT qid, doc_id, rank, 1 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY coverage DESC, weight DESC, doc_id) AS rank FROM g) WHERE rank <= 5)
      SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY list, rank, doc_id) AS place, list FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY list, rank) AS k FROM u) WHERE k = 1"""),
    "work_items": (work_items, "SELECT l_partkey AS key, count(DISTINCT s_nationkey) AS sources, count(DISTINCT l_orderkey) AS documents FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1 HAVING sources >= 5"),
    "value_fold": (value_fold, "SELECT v AS value, CASE v WHEN 'sup 1 is resolved' THEN 'resolved' WHEN 'liam maria' THEN 'liam' WHEN 'liam maria joe' THEN 'liam' ELSE v END AS stands_for FROM (VALUES " + ", ".join(f"('{v}')" for v in VALUES) + ") t(v)"),
}
