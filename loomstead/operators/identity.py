"""Entity resolution: surfaces of people, blocking, evidence scores by noisy-or, and constrained clustering.

A surface is a written form: (key, kind, value, org, count, tokens), kind email, handle or name. Blocks over ``MOST_IN_BLOCK``
are left out and reported. A merge is refused if it would join two organisations or two mailboxes; since a merge touches
two clusters only, clusters of different connected components can't meet, and each component is clustered on its own.
"""

from __future__ import annotations

import re
import tempfile
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import handle_tokens, is_email, looks_like_handle, looks_like_person_name, name_tokens, norm_name
from .priors import domain_label
from ..sources.store import ship

#: The organisation of all addresses at home.
HOME = "home"
# Limits and weights of evidence.
MOST_IN_BLOCK, FEWEST, THRESHOLD = 240, 5, 0.70
WEIGHTS = {"STATED_BINDING": 0.99, "LOCAL_EQUALS_NAME": 0.95, "HANDLE_EQUALS_LOCAL": 0.90, "HANDLE_EQUALS_NAME": 0.88, "NAME_EQUALS_NAME": 0.88, "INITIAL_SURNAME": 0.72, "ABBREVIATED_NAME": 0.72, "UNIQUE_GIVEN_NAME": 0.75}


def minded(occurrences: DataFrame, qualifiers: Column | None = None) -> DataFrame:
    """Occurrences (kind, value, ...) that have the shape of their kind, names in their normal form; a name that isn't one may still be a handle."""
    name = looks_like_person_name(F.col("value"), qualifiers)
    kind = F.when((F.col("kind") == "name") & ~name, "handle").otherwise(F.col("kind"))
    value = F.when(F.col("kind") == "name", norm_name(F.col("value"), qualifiers)).otherwise(F.lower(F.trim("value")))
    out = occurrences.withColumn("kind", kind).withColumn("value", value)
    return out.where(F.when(F.col("kind") == "email", is_email(F.col("value"))).when(F.col("kind") == "handle", looks_like_handle(F.col("value"))).otherwise(F.lit(True)))


def surfaces(seen: DataFrame, home: DataFrame | None = None, functional: DataFrame | None = None, qualifiers: Column | None = None) -> DataFrame:
    """Occurrences (kind, value, org, doc_id) to surfaces with their counts, documents, organisation and tokens.

    An address belongs to the organisation of its domain; those in ``home`` (label) are one. Mailboxes in ``functional`` (local)
    are marked.
    """
    low = seen.withColumn("value", F.lower(F.trim("value")))
    found = low.groupBy("kind", "value").agg(F.count("*").alias("count"), F.count_distinct("doc_id").alias("documents"), F.count_distinct("org").alias("orgs"), F.min("org").alias("org"))
    local = F.substring_index("value", "@", 1)
    tokens = F.when(F.col("kind") == "name", name_tokens(F.col("value"), qualifiers)).otherwise(handle_tokens(F.when(F.col("kind") == "email", local).otherwise(F.col("value")), qualifiers))
    found = found.withColumn("key", F.concat_ws(":", "kind", "value")).withColumn("tokens", tokens)
    found = found.withColumn("org", F.when(F.col("kind") == "email", domain_label(F.col("value")))).withColumn("local", F.when(F.col("kind") == "email", local))
    if home is not None:
        found = found.join(home.select(F.col("label").alias("org")).distinct().withColumn("at_home", F.lit(True)), "org", "left")
        found = found.withColumn("org", F.when(F.col("at_home"), HOME).otherwise(F.col("org"))).drop("at_home")
    if functional is None:
        return found.withColumn("is_functional", F.lit(False)).drop("local")
    found = found.join(functional.select("local").distinct().withColumn("f", F.lit(True)), "local", "left")
    return found.withColumn("is_functional", F.coalesce("f", F.lit(False))).drop("local", "f")


def counted_by(seen: DataFrame, by: str) -> DataFrame:
    """(key, by, count) of occurrences: how often each surface comes from each source or stands with each organisation."""
    key = F.concat_ws(":", "kind", F.lower(F.trim("value")))
    return seen.where(F.coalesce(F.col(by), F.lit("")) != "").groupBy(key.alias("key"), by).agg(F.count("*").alias("count"))


def hard_links(bindings: DataFrame) -> DataFrame:
    """(name, email) bindings seen together, with how often."""
    return bindings.select(F.lower("name").alias("name"), F.lower("email").alias("email")).groupBy("name", "email").agg(F.count("*").alias("times"))


def shared_mailboxes(links: DataFrame, functional: DataFrame | None = None) -> DataFrame:
    """(email, names): addresses bound to several names, and, whatever is bound to them, those whose mailbox is in ``functional`` (local)."""
    bound = links.groupBy("email").agg(F.count_distinct("name").alias("names"))
    if functional is None:
        return bound.where("names > 1")
    of_all = functional.select("local").distinct().withColumn("f", F.lit(True))
    return bound.withColumn("local", F.substring_index("email", "@", 1)).join(of_all, "local", "left").where("names > 1 OR f").select("email", "names")


def exclusive_links(links: DataFrame, functional: DataFrame | None = None) -> DataFrame:
    return links.join(shared_mailboxes(links, functional), "email", "left_anti").select(*links.columns)


def working_set(found: DataFrame, links: DataFrame, functional: DataFrame | None = None) -> DataFrame:
    """Surfaces seen often, or bound by a link that isn't shared; shared and functional mailboxes are out."""
    shared = shared_mailboxes(links, functional).select(F.concat(F.lit("email:"), "email").alias("key"))
    shared = shared.union(found.where("is_functional").select("key")).distinct()
    own = exclusive_links(links, functional)
    bound = own.select(F.concat(F.lit("name:"), "name").alias("key")).union(own.select(F.concat(F.lit("email:"), "email"))).distinct().withColumn("bound", F.lit(True))
    return found.join(shared, "key", "left_anti").join(bound, "key", "left").where((F.col("count") >= FEWEST) | F.col("bound")).drop("bound")


def block_keys(tokens: Column) -> Column:
    """compact:, first:, last: and init: keys of a surface."""
    first, last = F.get(tokens, F.lit(0)), F.element_at(tokens, -1)
    many = F.size(tokens) >= 2
    return F.filter(F.array(
        F.concat(F.lit("compact:"), F.array_join(tokens, "")), F.when(many, F.concat(F.lit("first:"), first)), F.when(many, F.concat(F.lit("last:"), last)),
        F.when(many, F.concat(F.lit("init:"), F.left(first, F.lit(1)), F.lit("|"), last)).when(F.length(first) > 2, F.concat(F.lit("init:"), F.left(first, F.lit(1)), F.lit("|"), F.substring(first, F.lit(2), F.length(first)))),
    ), lambda k: k.isNotNull())


def blocks(found: DataFrame) -> DataFrame:
    own = found.where(F.size("tokens") > 0).select("key", F.explode(F.array_distinct(block_keys(F.col("tokens")))).alias("block"))
    return own.join(own.groupBy("block").agg(F.count("*").alias("n")), "block")


def candidate_pairs(found: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Pairs of surfaces in a block of 2 to MOST_IN_BLOCK, a bounded self-join on the block, and those that a link binds, whatever their blocks."""
    if links is not None:
        return candidate_pairs(found).union(stated_pairs(found, links)).distinct()
    own = blocks(found).where(F.col("n").between(2, MOST_IN_BLOCK)).select("block", "key")
    return own.withColumnRenamed("key", "a").join(own.withColumnRenamed("key", "b"), "block").where("a < b").select("a", "b").distinct()


def stated_pairs(found: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of surfaces that a hard link binds, whatever blocks they are in."""
    name, email = F.concat(F.lit("name:"), "name"), F.concat(F.lit("email:"), "email")
    pairs = links.select(F.least(name, email).alias("a"), F.greatest(name, email).alias("b")).distinct()
    return pairs.join(found.select(F.col("key").alias("a")), "a", "left_semi").join(found.select(F.col("key").alias("b")), "b", "left_semi").select("a", "b")


def dropped_blocks(found: DataFrame, limit: int = 10) -> DataFrame:
    """The largest blocks that are left out, for the report."""
    return blocks(found).where(F.col("n") > MOST_IN_BLOCK).select("block", "n").distinct().orderBy(F.desc("n"), "block").limit(limit)


def sole_owner(found: DataFrame, key: Column) -> DataFrame:
    """(k, only): the one compact full name that owns a given name or an initial key, where it is one."""
    return found.where((F.col("kind") == "name") & (F.size("tokens") >= 2)).select(key.alias("k"), F.array_join("tokens", "").alias("form")).groupBy("k").agg(F.min("form").alias("only"), F.count_distinct("form").alias("n")).where("n = 1").drop("n")


def scored(pairs: DataFrame, found: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, score, signals): 1 - the product of (1 - weight) over the signals that fire."""
    given = F.get("tokens", F.lit(0))
    initial = F.concat(F.left(given, F.lit(1)), F.lit("|"), F.element_at("tokens", -1))
    side = found.select("key", "kind", "tokens", F.array_join("tokens", "").alias("compact"), F.size("tokens").alias("n"), given.alias("given"), initial.alias("initial"))
    side = side.join(sole_owner(found, given).toDF("given", "given_owner"), "given", "left").join(sole_owner(found, initial).toDF("initial", "initial_owner"), "initial", "left")
    a, b = (side.select(F.col("key").alias(x), F.struct("kind", "compact", "n", "given", "initial", "given_owner", "initial_owner", "tokens").alias(x + "s")) for x in "ab")
    bound = links.select(F.concat(F.lit("name:"), "name").alias("x"), F.concat(F.lit("email:"), "email").alias("y"))
    bound = bound.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().withColumn("stated", F.lit(True))
    df = pairs.join(a, "a").join(b, "b").join(bound, ["a", "b"], "left")

    def of(kind: str, field: str) -> Column:
        return F.when(F.col("as.kind") == kind, F.col(f"as.{field}")).otherwise(F.col(f"bs.{field}"))

    def kinds(x: str, y: str) -> Column:
        return (F.col("as.kind") == x) & (F.col("bs.kind") == y) | (F.col("as.kind") == y) & (F.col("bs.kind") == x)

    def initial_surname(x: str) -> Column:
        """A one-token form that is a name's initial and last token, or an initial form of the same."""
        last = F.element_at(of("name", "tokens"), -1)
        return (of("name", "n") >= 2) & (of(x, "compact") == F.concat(F.left(of("name", "given"), F.lit(1)), last)) & (of("name", "initial_owner") == of("name", "compact"))

    def unique_given(x: str) -> Column:
        return (of(x, "n") == 1) & (of(x, "compact") == of("name", "given")) & (of("name", "given_owner") == of("name", "compact"))

    full = of("name", "n") >= 2
    same = F.col("as.compact") == F.col("bs.compact")
    short = (F.col("as.n") >= 2) & (F.col("bs.n") >= 2) & (F.col("as.initial") == F.col("bs.initial")) & ((F.length("as.given") == 1) | (F.length("bs.given") == 1)) & ((F.col("as.initial_owner").isNotNull()) | (F.col("bs.initial_owner").isNotNull()))
    signal = (
        F.when(kinds("email", "name") & full & same, "LOCAL_EQUALS_NAME").when(kinds("email", "name") & initial_surname("email"), "INITIAL_SURNAME").when(kinds("email", "name") & full & unique_given("email"), "UNIQUE_GIVEN_NAME")
        .when(kinds("handle", "email") & same, "HANDLE_EQUALS_LOCAL")
        .when(kinds("handle", "name") & full & same, "HANDLE_EQUALS_NAME").when(kinds("handle", "name") & initial_surname("handle"), "INITIAL_SURNAME").when(kinds("handle", "name") & full & unique_given("handle"), "UNIQUE_GIVEN_NAME")
        .when((F.col("as.kind") == "name") & (F.col("bs.kind") == "name") & same, "NAME_EQUALS_NAME").when((F.col("as.kind") == "name") & (F.col("bs.kind") == "name") & short, "ABBREVIATED_NAME")
    )
    signals = F.filter(F.array(F.when(F.col("stated"), "STATED_BINDING"), signal), lambda s: s.isNotNull())
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    left = F.aggregate("signals", F.lit(1.0), lambda p, s: p * (F.lit(1.0) - F.element_at(weight, s)))
    out = df.withColumn("signals", signals).where(F.size("signals") > 0)
    return out.select("a", "b", (F.floor((1.0 - left) * 1e4 + 0.5) / 1e4).alias("score"), F.array_join("signals", "|").alias("signals"))


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the cluster's shared folder; a temporary one only where none is named and all runs in one process."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomstead-"))
    return df.checkpoint()


def minimum_labels(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b) over text keys: labels are lowered along edges and then looked up again, until none changes."""
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct().persist()
    labels = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label"))
    while True:
        near = both.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("label").alias("near"))
        lower = labels.join(near, "x").select("x", F.least("label", "near").alias("low"), "label")
        jump = labels.select(F.col("x").alias("low"), F.col("label").alias("further"))
        step = lower.join(jump, "low", "left").select("x", F.least("low", "further").alias("next"), "label")
        step = checkpointed(step)
        changed = step.where("next <> label").limit(1).count()
        labels = step.select("x", F.col("next").alias("label"))
        if not changed:
            return labels.toDF("node", "component")


def _mailbox(key: str) -> str:
    return re.sub("[0-9]", "", key.split(":", 1)[1].split("@")[0].split("+")[0]).strip(".")


def cluster(pairs: pd.DataFrame) -> pd.DataFrame:
    """Best-first union of one component's pairs (a, b, score, signals, org_a, org_b); a merge into two organisations or mailboxes is refused."""
    parent: dict[str, str] = {}
    orgs: dict[str, set] = {}
    boxes: dict[str, set] = {}
    for side in "ab":
        for key, org in zip(pairs[side], pairs[f"org_{side}"], strict=True):
            parent[key] = key
            orgs[key] = {org} if isinstance(org, str) and org else set()
            boxes[key] = {_mailbox(key)} if key.startswith("email:") else set()

    def root(x: str) -> str:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    refused: dict[str, int] = {}
    for row in pairs.sort_values(["score", "a", "b"], ascending=[False, True, True], kind="stable").itertuples():
        x, y = sorted((root(row.a), root(row.b)))
        if x == y:
            continue
        if len(orgs[x] | orgs[y]) > 1 or len(boxes[x] | boxes[y]) > 1 and "STATED_BINDING" not in row.signals:
            refused[row.a] = refused.get(row.a, 0) + 1
            continue
        parent[y] = x
        orgs[x] |= orgs[y]
        boxes[x] |= boxes[y]
    return pd.DataFrame([(k, root(k), refused.get(k, 0)) for k in sorted(parent)], columns=["key", "entity", "refused"])


def entities(scores: DataFrame, found: DataFrame) -> DataFrame:
    """(key, entity, refused) of every surface: components of the pairs over the threshold, clustered one by one."""
    ship(scores.sparkSession)
    strong = scores.where(F.col("score") >= THRESHOLD)
    part = minimum_labels(strong.select("a", "b"))
    org = found.select("key", "org")
    rows = strong.join(part.toDF("a", "component"), "a").join(org.toDF("a", "org_a"), "a").join(org.toDF("b", "org_b"), "b")
    own = rows.groupBy("component").applyInPandas(lambda pdf: cluster(pdf), "key string, entity string, refused long")
    return found.select("key").join(own, "key", "left").select("key", F.coalesce("entity", "key").alias("entity"), F.coalesce("refused", F.lit(0)).cast("bigint").alias("refused"))


def accepted(scores: DataFrame, clustered: DataFrame) -> DataFrame:
    """(entity, a, b, score, signals): evidence over the threshold between two surfaces of one entity."""
    of = clustered.select("key", "entity")
    both = scores.where(F.col("score") >= THRESHOLD).join(of.toDF("a", "entity"), "a").join(of.toDF("b", "other"), "b")
    return both.where("entity = other").select("entity", "a", "b", "score", "signals")


def canonical(clustered: DataFrame, found: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """One row for each entity, eid numbering them by occurrences.

    Its name is the most frequent, then longest, of two tokens or more; else the best address's tokens; else the most frequent
    form. Its confidence is its weakest evidence among ``merges``, or 1.
    """
    both = clustered.join(found, "key")
    named, mail = (F.col("kind") == "name") & (F.size("tokens") >= 2), F.col("kind") == "email"
    kind = F.when(named, 2).when(mail, 1).otherwise(0)
    said = F.when(mail, F.array_join("tokens", " ")).otherwise(F.col("value"))
    best = F.max_by(said, F.struct(kind, "count", F.length("value"), "value"))
    rows = both.groupBy("entity").agg(best.alias("name"), F.count("*").alias("forms"), F.sum("count").alias("occurrences"))
    if merges is not None:
        rows = rows.join(merges.groupBy("entity").agg(F.min("score").alias("confidence")), "entity", "left").withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
    return numbered(rows)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``number`` and ``eid`` by occurrences, then entity: ranges of occurrences are sorted apart and begin where the ones before end."""
    spark, width = rows.sparkSession, 64
    edges = rows.select(F.percentile_approx("occurrences", [i / width for i in range(1, width)], 10_000)).first()[0] or []
    edges = sorted(set(edges), reverse=True)
    place = F.lit(len(edges))
    for i, edge in reversed(list(enumerate(edges))):
        place = F.when(F.col("occurrences") >= edge, i).otherwise(place)
    # within a range, equal numbers of occurrences (most entities have one) are dealt out by the entity's first letters
    rows = checkpointed(rows.withColumn("range", place).withColumn("part", F.rpad(F.left("entity", F.lit(8)), 8, " ")))
    sizes = rows.groupBy("range", "occurrences", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("range").orderBy(F.desc("occurrences"), "part").rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.withColumn("own", F.coalesce(F.sum("n").over(before), F.lit(0)))
    totals = dict(map(tuple, sizes.groupBy("range").agg(F.sum("n")).collect()))  # at most ``width`` rows
    begins, at = [], 0
    for i in sorted(totals):
        begins.append((i, at))
        at += totals[i]
    begins = spark.createDataFrame(begins, "range int, begin long")
    own = Window.partitionBy("range", "occurrences", "part").orderBy("entity")
    out = rows.withColumn("k", F.row_number().over(own)).join(inside.drop("n"), ["range", "occurrences", "part"]).join(F.broadcast(begins), "range")
    number = (F.col("begin") + F.col("own") + F.col("k")).cast("bigint")
    return out.withColumn("number", number).withColumn("eid", F.concat(F.lit("ent_"), F.lpad(number.cast("string"), 6, "0"))).drop("range", "part", "k", "own", "begin")


def best_evidence(clustered: DataFrame, merges: DataFrame) -> DataFrame:
    """(key, entity, score, signals) of each alias: its strongest evidence, or that it stands alone."""
    sides = merges.select(F.col("a").alias("key"), "score", "signals").union(merges.select("b", "score", "signals"))
    best = sides.groupBy("key").agg(F.max_by(F.struct("score", "signals"), F.struct("score", "signals")).alias("best"))
    return clustered.join(best, "key", "left").select(
        "key", "entity", F.coalesce("best.score", F.lit(1.0)).alias("score"), F.coalesce("best.signals", F.lit("SOLE_SURFACE")).alias("signals"))


def diagnostics(found: DataFrame, working: DataFrame, pairs: DataFrame, scores: DataFrame, clustered: DataFrame) -> DataFrame:
    """(stage, n): how many surfaces, candidates, scored pairs, merges and entities there are."""
    counts = [
        ("surfaces", found), ("working", working), ("pairs", pairs), ("scored", scores), ("strong", scores.where(F.col("score") >= THRESHOLD)),
        ("entities", clustered.select("entity").distinct()),
    ]
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(stage).alias("stage"), "n") for stage, df in counts]
    return reduce(DataFrame.union, parts)
