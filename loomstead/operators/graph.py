"""Vertices and edges as tables; traversals of one to three hops as joins, histories as a bounded recursion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import bounded


def existing(edges: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """Edges (src, dst, ...) whose two ends exist, once for each pair of ends."""
    return edges.join(src.select(F.col(src.columns[0]).alias("src")), "src", "left_semi").join(dst.select(F.col(dst.columns[0]).alias("dst")), "dst", "left_semi").dropDuplicates(["src", "dst"]).select(edges.columns)


def mention_edges(mentions: DataFrame) -> DataFrame:
    """(eid, doc_id, kind) occurrences as one edge for each entity and document: how often, and the kinds in order."""
    return mentions.groupBy("eid", "doc_id").agg(F.count("*").alias("mention_count"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def unique_lookup(aliases: DataFrame, functional: DataFrame | None = None) -> DataFrame:
    """(kind, surface) to its one entity, or null where it could be several; entities with a functional mailbox are left out."""
    if functional is not None:
        aliases = aliases.join(functional.select("eid").distinct(), "eid", "left_anti")
    one = aliases.withColumn("surface", F.lower("surface")).groupBy("kind", "surface").agg(F.count_distinct("eid").alias("entities"), F.min("eid").alias("eid"))
    return one.select("kind", "surface", "entities", F.when(F.col("entities") == 1, F.col("eid")).alias("eid"))


def linked(surfaces: DataFrame, lookup: DataFrame) -> DataFrame:
    """(doc_id, kind, surface) with its entity and whether it is linked, ambiguous or unresolved."""
    found = surfaces.withColumn("surface", F.lower("surface")).join(lookup, ["kind", "surface"], "left")
    return found.withColumn("outcome", F.when(F.col("eid").isNotNull(), "linked").when(F.col("entities") > 1, "ambiguous").otherwise("unresolved"))


def round_robin(lists: DataFrame, item: str = "doc_id") -> DataFrame:
    """(list, rank, item) to the items in turn: all first ones in the order of the lists, then all second ones; the first time counts."""
    first = Window.partitionBy(item).orderBy("rank", "list")
    return lists.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").orderBy("rank", "list", item)


def documents_for(edges: DataFrame, seeds: DataFrame, each: int, limit: int) -> DataFrame:
    """(list, key) seeds to documents by edges (key, doc_id): at most ``each`` for a seed, then round-robin up to ``limit``."""
    near = edges.join(seeds, "key").withColumn("rank", F.row_number().over(Window.partitionBy("list").orderBy("doc_id"))).where(F.col("rank") <= each)
    return round_robin(near.select("list", "rank", "doc_id")).limit(limit)


def scopes(edges: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """(qid, doc_id, place) of seeds (qid, list, key) by edges (key, doc_id): for each question its lists in turn, a document once, up to ``limit``."""
    near = edges.select("key", "doc_id").join(bounded(seeds.select("key").distinct()), "key", "left_semi").distinct().join(seeds, "key")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "list").orderBy("doc_id"))).where(F.col("rank") <= limit)
    return in_turn(near.select("qid", "list", "rank", "doc_id"), limit)


def in_turn(lists: DataFrame, limit: int) -> DataFrame:
    """(qid, doc_id, place) of (qid, list, rank, doc_id): for each question all first ones in the order of the lists, then all second ones."""
    first = Window.partitionBy("qid", "doc_id").orderBy("rank", "list")
    once = lists.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "list", "doc_id")).cast("bigint")
    return once.withColumn("place", place).where(F.col("place") <= limit).select("qid", "doc_id", "place")


def entities_for(edges: DataFrame, docs: DataFrame, each: int) -> DataFrame:
    """Entities of the documents (doc_id), at most ``each`` for a document, with how many of the documents name them."""
    near = edges.join(docs.select("doc_id").distinct(), "doc_id").select("eid", "doc_id").distinct()
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("eid"))).where(F.col("n") <= each)
    return near.groupBy("eid").agg(F.count_distinct("doc_id").alias("documents"))


def connected(edges: DataFrame, found: DataFrame, first: int, each: int) -> DataFrame:
    """(qid, eid, documents, place): who the first ``first`` documents of each question (qid, doc_id, place) name, most documents first, then who comes first."""
    own = Window.partitionBy("qid").orderBy("place")
    few = found.withColumn("at", F.row_number().over(own)).where(F.col("at") <= first).select("qid", "doc_id", "at")
    few = bounded(few)
    near = edges.select("eid", "doc_id").join(bounded(few.select("doc_id").distinct()), "doc_id", "left_semi").distinct().join(few, "doc_id")
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy("eid"))).where(F.col("n") <= each)
    people = near.groupBy("qid", "eid").agg(F.count_distinct("doc_id").alias("documents"), F.min("at").alias("seen"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("documents"), "seen", "eid")).cast("bigint")
    return people.select("qid", "eid", "documents", place.alias("place"))


def denoted_by(text: DataFrame, aliases: DataFrame) -> DataFrame:
    """Texts (text) with the entities that they denote in aliases (surface, eid), and how many those are."""
    low = aliases.select(F.lower(F.trim("surface")).alias("text"), "eid").distinct()
    low = bounded(low.withColumn("entities", F.count("*").over(Window.partitionBy("text"))))
    own = text.select(F.lower(F.trim("text")).alias("text"))
    said = bounded(own.join(low.select("text").distinct(), "text", "left_semi").distinct())  # most texts are no one's form
    return said.join(low, "text")


def surfaces_of(aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """(eid, form, kind): every written form of the entities, one row for each kind."""
    return aliases.join(entities.select("eid").distinct(), "eid", "left_semi").select("eid", F.lower(F.trim("surface")).alias("form"), "kind").distinct()


def aliases_of(aliases: DataFrame, entities: DataFrame, limit: int = 8) -> DataFrame:
    """(eid, place, surface, kind, score, signals): the ``limit`` most frequent forms of each entity and what speaks for them."""
    own = aliases.join(entities.select("eid").distinct(), "eid", "left_semi")
    place = F.row_number().over(Window.partitionBy("eid").orderBy(F.desc("occurrences"), "surface", "kind")).cast("bigint")
    return own.withColumn("place", place).where(F.col("place") <= limit).select("eid", "place", "surface", "kind", "score", "signals")


def together(edges: DataFrame, pairs_of: DataFrame) -> DataFrame:
    """Documents that join two of the given entities (eid)."""
    own = edges.join(pairs_of.select("eid").distinct(), "eid").select("eid", "doc_id").distinct()
    a, b = own.toDF("a", "doc_id"), own.toDF("b", "doc_id")
    return a.join(b, "doc_id").where("a < b").select("a", "b", "doc_id")


def exposure(claim_docs: DataFrame, roles: list[tuple[str, DataFrame]], each: int | None = None) -> DataFrame:
    """Who is exposed to a claim (claim_id, doc_id) through a document: one row for each person at the strongest role, first listed first.

    Roles are edges (eid, name, doc_id); ``each`` limits a role's rows before that. Names alike but for case are one person.
    """
    parts = []
    for rank, (role, edges) in enumerate(roles):
        near = claim_docs.join(edges, "doc_id").select("claim_id", "eid", "name", F.lit(role).alias("role"), F.lit(rank).alias("rank"))
        if each is not None:
            near = near.distinct().withColumn("n", F.row_number().over(Window.partitionBy("claim_id").orderBy("eid"))).where(F.col("n") <= each).drop("n")
        parts.append(near)
    who = F.coalesce(F.nullif(F.lower("name"), F.lit("")), F.col("eid").cast("string"))
    best = Window.partitionBy("claim_id", "who").orderBy("rank", "name", "eid")
    return reduce(DataFrame.unionByName, parts).withColumn("who", who).withColumn("n", F.row_number().over(best)).where("n = 1").select("claim_id", "who", "eid", "role")


def history(edges: DataFrame, depth: int = 6) -> DataFrame:
    """(root, length, path) of the longest chain along edges (src, dst) from each node that nothing points to, at most ``depth`` edges.

    The hops are joins unrolled over the bound; of chains of one length the least path counts.
    """
    edges = edges.select("src", "dst").distinct()
    roots = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_anti").select(F.col("src").alias("root")).distinct()
    at = roots.select("root", F.col("root").alias("node"), F.array("root").alias("path"))
    found = [at]
    for _ in range(depth):
        at = at.join(edges, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select("root", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        found.append(at)
    every = reduce(DataFrame.union, found).select("root", (F.size("path") - 1).cast("bigint").alias("length"), "path")
    best = Window.partitionBy("root").orderBy(F.desc("length"), "path")
    return every.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def containers(memberships: DataFrame) -> DataFrame:
    """(source, kind, name, doc_id) to containers with their number of documents; names are trimmed, lowered and lose a leading #."""
    name = F.regexp_replace(F.lower(F.trim("name")), "^#", "")
    ok = memberships.withColumn("name", name).where((F.length("name") >= 2) & ~F.col("name").rlike("^[0-9]+$"))
    return ok.groupBy("source", "kind", "name").agg(F.count_distinct("doc_id").alias("documents")).withColumn("key", F.concat_ws(":", "source", "kind", "name"))


def container_tokens(found: DataFrame) -> DataFrame:
    return found.select("key", F.explode(F.array_distinct(F.expr(r"regexp_extract_all(name, '[\\p{L}\\p{N}]+', 0)"))).alias("token"))


def containers_named(found: DataFrame, question: str, hint: str | None = None, limit: int = 4) -> DataFrame:
    """Containers whose name's tokens are all in the question: most tokens first, then the hinted source, then the smallest."""
    asked = F.expr("regexp_extract_all(lower(question), '[\\\\p{L}\\\\p{N}]+', 0)")
    own = container_tokens(found).groupBy("key").agg(F.collect_set("token").alias("tokens")).withColumn("question", F.lit(question))
    hit = own.where(F.size(F.array_except("tokens", asked)) == 0).join(found, "key").withColumn("n", F.size("tokens").cast("bigint"))
    hinted = F.when(F.col("source") == F.lit(hint), 0).otherwise(1)
    return hit.orderBy(F.desc("n"), hinted, "documents", "key").limit(limit).select("key", "n", "documents")


def budgeted(found: DataFrame, memberships: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Documents of the containers ``keys``, smallest container first, each document once, up to ``limit``."""
    own = found.where(F.col("key").isin(keys)).withColumn("place", F.row_number().over(Window.orderBy("documents", "key")))  # a row for each asked key
    near = memberships.join(F.broadcast(own.select("key", "place")), "key").groupBy("doc_id").agg(F.min("place").cast("bigint").alias("place"))
    return near.orderBy("place", "doc_id").limit(limit)
