"""A property graph derived from customers, orders and nations, and the queries of traversal over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def mentions(spark, sf):
    """An order is a document that names its customer, once more by each line of the order."""
    lines = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linestatus").alias("kind"))
    return lines.join(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("eid")), "doc_id")


def role(spark, sf, priority: str | None) -> DataFrame:
    orders = _t(spark, sf, "orders")
    if priority:
        orders = orders.where(F.col("o_orderpriority") == priority)
    people = _t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    return orders.join(people, "o_custkey").select(F.col("o_custkey").alias("eid"), "name", F.col("o_orderkey").alias("doc_id"))


def memberships(spark, sf):
    """Orders are in the containers of their customer's segment and nation."""
    who = _t(spark, sf, "customer").join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = _t(spark, sf, "orders").join(who, F.col("o_custkey") == F.col("c_custkey"))
    both = F.array(F.struct(F.lit("folder").alias("kind"), F.col("c_mktsegment").alias("name")), F.struct(F.lit("channel").alias("kind"), F.concat(F.lit("#"), F.col("n_name")).alias("name")))
    return rows.select(F.lit("orders").alias("source"), F.inline(both).alias("kind", "name"), F.col("o_orderkey").alias("doc_id"))


def mention_edges(spark, sf):
    return G.mention_edges(mentions(spark, sf))


def role_edges(spark, sf):
    return role(spark, sf, "1-URGENT").select("eid", "doc_id", F.lit("SENT").alias("role")).union(role(spark, sf, "2-HIGH").select("eid", "doc_id", F.lit("SPOKE_IN").alias("role")))


def dangling_edges(spark, sf):
    """Of edges that point to customers with a positive balance only, those that stay."""
    edges = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    return G.existing(edges, _t(spark, sf, "orders").select("o_orderkey"), _t(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey"))


def denotes(spark, sf):
    """All part names as surfaces, looked up among the names of sold sizes (10 and more), the ontology: linked, ambiguous or unresolved."""
    aliases = _t(spark, sf, "part").select(F.col("p_brand").alias("eid"), F.lit("name").alias("kind"), F.col("p_name").alias("surface"), "p_size")
    asked = _t(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("name").alias("kind"), F.upper("p_name").alias("surface"))
    return G.linked(asked, G.unique_lookup(aliases.where("p_size >= 10"))).select("doc_id", "surface", "entities", "eid", "outcome")


def docs_for_entities(spark, sf):
    edges = _t(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("doc_id"))
    seeds = spark.createDataFrame([(0, 7), (1, 10), (2, 13), (3, 16)], "list long, key long")
    return G.documents_for(edges, seeds, 8, 20)


def entities_for_docs(spark, sf):
    return G.entities_for(mentions(spark, sf), _t(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id")), 3)


def cooccurrence(spark, sf):
    """Suppliers that share an order."""
    edges = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("eid"), F.col("l_orderkey").alias("doc_id"))
    return G.together(edges, _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("eid"))).groupBy("a", "b").agg(F.count("*").alias("documents"))


def blast_radius(spark, sf):
    """Who is exposed to each part (as a claim) through the orders that hold it."""
    claims = _t(spark, sf, "lineitem").select(F.col("l_partkey").alias("claim_id"), F.col("l_orderkey").alias("doc_id")).distinct()
    return G.exposure(claims, [("sent", role(spark, sf, "1-URGENT")), ("spoke in", role(spark, sf, "2-HIGH")), ("named in", role(spark, sf, None))])


def event_history(spark, sf):
    """Each event supersedes the user's previous one of its type; chains of at most six from the latest."""
    from pyspark.sql import Window

    events = _t(spark, sf, "events")
    last = F.lag("event_id").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    edges = events.select(F.col("event_id").alias("src"), last.alias("dst")).where("dst IS NOT NULL")
    return G.history(edges).select("root", "length", F.array_join("path", ">").alias("path"))


def container_build(spark, sf):
    return G.containers(memberships(spark, sf))


def container_tokens(spark, sf):
    return G.container_tokens(G.containers(memberships(spark, sf)))


def containers_named(spark, sf):
    return G.containers_named(G.containers(memberships(spark, sf)), "What did Building and machinery customers, or those of the NATION_3, order?")


def documents_in(spark, sf):
    found = G.containers(memberships(spark, sf))
    keyed = memberships(spark, sf).select(F.concat_ws(":", "source", "kind", F.regexp_replace(F.lower(F.trim("name")), "^#", "")).alias("key"), "doc_id")
    keys = [r.key for r in found.orderBy("key").limit(3).collect()]
    return G.budgeted(found, keyed, keys, 500)


MEMBERS = """WITH m AS (SELECT 'orders' AS source, 'folder' AS kind, lower(trim(c_mktsegment)) AS name, o_orderkey AS doc_id FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'orders', 'channel', lower(trim(n_name)), o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
found AS (SELECT source, kind, name, count(DISTINCT doc_id) AS documents, source || ':' || kind || ':' || name AS key FROM m WHERE length(name) >= 2 AND NOT regexp_full_match(name, '[0-9]+') GROUP BY ALL),
tokens AS (SELECT DISTINCT key, unnest(regexp_extract_all(name, '[\\p{L}\\p{N}]+')) AS token FROM found)
"""
QUERIES = {
    "mention_edges": (mention_edges, "SELECT o_custkey AS eid, o_orderkey AS doc_id, count(*) AS mention_count, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS kinds FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"),
    "role_edges": (role_edges, "SELECT o_custkey AS eid, o_orderkey AS doc_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'SENT' ELSE 'SPOKE_IN' END AS role FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "endpoint_semi_joins": (dangling_edges, "SELECT DISTINCT o_orderkey AS src, o_custkey AS dst FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"),
    "denotes": (denotes, """WITH l AS (SELECT lower(p_name) AS surface, count(DISTINCT p_brand) AS entities, min(p_brand) AS b FROM part WHERE p_size >= 10 GROUP BY 1)
      SELECT p_partkey AS doc_id, lower(p_name) AS surface, entities, CASE WHEN entities = 1 THEN b END AS eid, CASE WHEN entities = 1 THEN 'linked' WHEN entities > 1 THEN 'ambiguous' ELSE 'unresolved' END AS outcome FROM part LEFT JOIN l ON lower(p_name) = l.surface"""),
    "docs_for_entities": (docs_for_entities, """WITH s(list, key) AS (VALUES (0, 7), (1, 10), (2, 13), (3, 16)),
      n AS (SELECT CAST(list AS BIGINT) AS list, row_number() OVER (PARTITION BY list ORDER BY o_orderkey) AS rank, o_orderkey AS doc_id FROM orders JOIN s ON o_custkey = key),
      f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank, list) AS k FROM n WHERE rank <= 8) SELECT list, CAST(rank AS INT) AS rank, doc_id FROM f WHERE k = 1 ORDER BY rank, list, doc_id LIMIT 20"""),
    "entities_for_docs": (entities_for_docs, "SELECT o_custkey AS eid, count(DISTINCT o_orderkey) AS documents FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1"),
    "cooccurrence_paths": (cooccurrence, "WITH e AS (SELECT DISTINCT l_suppkey AS s, l_orderkey AS o FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier)) SELECT x.s AS a, y.s AS b, count(*) AS documents FROM e x JOIN e y ON x.o = y.o AND x.s < y.s GROUP BY ALL"),
    "blast_radius": (blast_radius, """WITH c AS (SELECT DISTINCT l_partkey AS claim_id, l_orderkey AS doc_id FROM lineitem),
      e AS (SELECT claim_id, lower(c_name) AS who, c_custkey AS eid, min(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END) AS r FROM c JOIN orders ON doc_id = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
      SELECT claim_id, who, eid, CASE r WHEN 0 THEN 'sent' WHEN 1 THEN 'spoke in' ELSE 'named in' END AS role FROM e"""),
    "claim_history": (event_history, """WITH RECURSIVE e AS (SELECT src, dst FROM (SELECT event_id AS src, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL),
      p AS (SELECT src AS root, src AS node, CAST(src AS VARCHAR) AS path, 0 AS n FROM e WHERE src NOT IN (SELECT dst FROM e) UNION ALL SELECT root, dst, path || '>' || dst, n + 1 FROM p JOIN e ON node = src WHERE n < 6),
      k AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY n DESC) AS i FROM p) SELECT root, CAST(n AS BIGINT) AS length, path FROM k WHERE i = 1"""),
    "container_build": (container_build, MEMBERS + "SELECT * FROM found"),
    "container_tokens": (container_tokens, MEMBERS + "SELECT * FROM tokens"),
    "containers_named": (containers_named, MEMBERS + """, q AS (SELECT regexp_extract_all(lower('What did Building and machinery customers, or those of the NATION_3, order?'), '[\\p{L}\\p{N}]+') AS asked)
      SELECT key, count(*) AS n, any_value(documents) AS documents FROM tokens JOIN found USING (key), q GROUP BY key HAVING bool_and(list_contains(asked, token)) ORDER BY n DESC, documents, key LIMIT 4"""),
    "documents_in": (documents_in, MEMBERS + """, k AS (SELECT key, documents FROM found ORDER BY key LIMIT 3), o AS (SELECT key, row_number() OVER (ORDER BY documents, key) AS place FROM k)
      SELECT doc_id, min(place) AS place FROM m JOIN o ON o.key = source || ':' || kind || ':' || name GROUP BY doc_id ORDER BY place, doc_id LIMIT 500"""),
}
