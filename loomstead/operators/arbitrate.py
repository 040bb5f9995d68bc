"""Arbitration of competing claims: group, fold values, score trust, decide or refuse; and the map of disagreements.

A claim has claim_id, subject, predicate, object_value, doc_id, source, asserted_at ('YYYY-MM-DD' or ''), extractor_confidence
and scope. All windows share the partitioning by (scope, subject, predicate), so arbitration is one shuffle.
Scores are rounded as floor(x * 1e4 + 0.5) / 1e4, so that they are the same number in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Authority by source, cost of staleness by predicate, and the constants of the trust score.
AUTHORITY = {"confluence": 1.00, "github": 0.98, "jira": 0.94, "linear": 0.94, "google_drive": 0.90, "hubspot": 0.84, "gmail": 0.80, "fireflies": 0.74, "slack": 0.70}
DEFAULT_AUTHORITY = 0.75
STALENESS = {"status": 0.45, "due_date": 0.45, "limit": 0.20, "owner": 0.20, "reports_to": 0.00}
DEFAULT_STALENESS = 0.20
CORROBORATION_STEP, CORROBORATION_CAP = 0.15, 1.30
HEDGES = r"\b(tbd|tba|probably|maybe|perhaps|possibly|unclear|unknown|approx\w*|around|roughly|about|likely|or)\b|[~?]"
NEGATIONS = r"\b(not|no|never|without|isn t|wasn t|won t|cannot|can t|un\w+)\b"
HEDGED, CONFIDENCE_FLOOR, TRUST_FLOOR, MARGIN = 0.65, 0.60, 0.50, 0.06

GROUP = ["scope", "subject_key", "predicate"]


def rounded(x: Column, places: int = 4) -> Column:
    scale = F.lit(10.0**places)
    return F.floor(x * scale + F.lit(0.5)).cast("double") / scale


def lookup(key: Column, values: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def subject_key(subject: Column) -> Column:
    """Case, punctuation and a leading article don't tell subjects apart."""
    text = F.regexp_replace(F.trim(F.lower(F.coalesce(subject, F.lit("")))), r"^(the|a|an)\s+", "")
    return F.trim(F.regexp_replace(text, r"[^a-z0-9]+", " "))


def value_key(value: Column) -> Column:
    """'30 percent', '30%' and '30 %' are one value."""
    text = F.replace(F.replace(F.trim(F.lower(value)), F.lit("per cent"), F.lit("%")), F.lit("percent"), F.lit("%"))
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"[^a-z0-9%]+", " ")), r"\s+%", "%")


def restates(short: Column, long: Column) -> Column:
    """Whether ``long`` says the same as ``short`` at more length: at word boundaries, with a letter, neither negating alone."""
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return (F.length(short) > 0) & (F.length(short) < F.length(long)) & short.rlike("[a-z]") & F.contains(pad(long), pad(short)) & (short.rlike(NEGATIONS) == long.rlike(NEGATIONS))


def fold(values: Column) -> Column:
    """Map from each value to the first shorter one that stands for itself and that it restates, or to itself."""
    kind = "array<struct<k:string,c:string>>"
    in_order = F.array_sort(F.transform(F.array_distinct(values), lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))

    def step(done: Column, x: Column) -> Column:
        stands = F.filter(done, lambda d: (d["k"] == d["c"]) & restates(d["k"], x["v"]))
        first = F.coalesce(F.get(stands, F.lit(0))["c"], x["v"])
        return F.concat(done, F.array(F.struct(x["v"].alias("k"), first.alias("c"))))

    return F.map_from_entries(F.aggregate(in_order, F.array().cast(kind), step))


def foldable(values: Column) -> Column:
    """Whether some value is a part of another: a plain search of strings, without patterns."""
    return (F.size(values) > 1) & F.exists(values, lambda x: F.exists(values, lambda y: (F.length(x) < F.length(y)) & F.contains(y, x)))


def day(date: Column) -> Column:
    """A day count for gaps; null unless the text is a date."""
    part = lambda a, n: F.substring(date, a, n).cast("int")
    return F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), part(1, 4) * 372 + part(6, 2) * 31 + part(9, 2))


def trusted(claims: DataFrame, folding: bool = True) -> DataFrame:
    """``claims`` with subject_key, value_key (folded), holders (claims of that value) and trust."""
    own = Window.partitionBy(*GROUP)
    df = claims.withColumn("subject_key", subject_key(F.col("subject"))).withColumn("value_key", value_key(F.col("object_value")))
    if folding:  # once a group, on one of its claims, and only where some value stands inside another
        df = df.withColumn("values", F.collect_set("value_key").over(own)).withColumn("first", F.min("claim_id").over(own) == F.col("claim_id"))
        df = df.withColumn("folded", F.when(F.col("first") & foldable(F.col("values")), fold(F.col("values")))).drop("values", "first")
        df = df.withColumn("folded", F.first("folded", ignorenulls=True).over(own)).withColumn("value_key", F.coalesce(F.element_at("folded", F.col("value_key")), "value_key")).drop("folded")
    df = df.withColumn("holders", F.count("*").over(Window.partitionBy(*GROUP, "value_key"))).withColumn("day", day(F.col("asserted_at")))
    low, high = F.min("day").over(own), F.max("day").over(own)
    newness = F.when(low.isNull() | (low == high), 1.0).when(F.col("day").isNull(), 0.5).otherwise((F.col("day") - low) / (high - low))
    agreement = F.least(F.lit(CORROBORATION_CAP), 1.0 + CORROBORATION_STEP * (F.col("holders") - 1))
    explicit = F.when(F.lower("object_value").rlike(HEDGES), HEDGED).otherwise(1.0)
    df = df.withColumn("authority", lookup(F.col("source"), AUTHORITY, DEFAULT_AUTHORITY)).withColumn("explicitness", explicit)
    score = F.least(F.lit(1.0), F.col("authority") * F.col("explicitness") * (CONFIDENCE_FLOOR + (1 - CONFIDENCE_FLOOR) * F.col("extractor_confidence")) * agreement)
    stale = lookup(F.col("predicate"), STALENESS, DEFAULT_STALENESS)
    return df.withColumn("trust", rounded(score * (1 - stale * (1 - newness))))


def arbitrate(claims: DataFrame, folding: bool = True) -> DataFrame:
    """Every claim with its trust, its value's place, its status, and the winner and runner-up of its group where values compete.

    Status: settled (one value), accepted, superseded, disputed. A decision needs a winner above the floor, a margin, and a
    signal that can be named.
    """
    df = trusted(claims, folding)
    inside = Window.partitionBy(*GROUP, "value_key").orderBy(F.desc("trust"), F.desc("asserted_at"), "doc_id", "claim_id")
    df = df.withColumn("place", F.row_number().over(inside))
    top = lambda c: F.max(F.when(F.col("place") == 1, F.col(c))).over(Window.partitionBy(*GROUP, "value_key"))
    df = df.withColumn("value_trust", top("trust")).withColumn("value_doc", top("doc_id"))
    own = Window.partitionBy(*GROUP)
    df = df.withColumn("value_rank", F.dense_rank().over(own.orderBy(F.desc("value_trust"), "value_doc", "value_key"))).withColumn("sides", F.max("value_rank").over(own))
    told = F.struct("claim_id", "subject", "object_value", "source", "asserted_at", "day", "trust", "holders", "authority", "explicitness", "extractor_confidence")
    for name, rank in (("winner", 1), ("runner", 2)):
        df = df.withColumn(name, F.first(F.when((F.col("value_rank") == rank) & (F.col("place") == 1), told), ignorenulls=True).over(own))
    w, r = (lambda c: F.col(f"winner.{c}")), (lambda c: F.col(f"runner.{c}"))
    recency = (lookup(F.col("predicate"), STALENESS, DEFAULT_STALENESS) > 0) & w("day").isNotNull() & r("day").isNotNull() & (w("asserted_at") > r("asserted_at"))
    undated = w("day").isNotNull() & r("day").isNull()
    signals = [
        (w("authority") > r("authority"), F.concat(w("source"), F.lit(" carries more authority than "), r("source"))),
        (w("holders") > r("holders"), F.concat(F.lit("corroborated by "), w("holders"), F.lit(" claims against "), r("holders"))),
        (recency, F.concat(F.lit("asserted later, "), w("asserted_at"), F.lit(" against "), r("asserted_at"))),
        (undated & ~recency, F.concat(F.lit("the alternative has no date, this one "), w("asserted_at"))),
        (w("explicitness") > r("explicitness"), F.lit("the alternative hedges its value")),
        (w("extractor_confidence") > r("extractor_confidence"), F.lit("extraction confidence was higher")),
    ]
    reason = F.concat_ws("; ", *[F.when(when, then) for when, then in signals])
    decided = (w("trust") >= TRUST_FLOOR) & (w("trust") - r("trust") >= MARGIN) & (reason != "")
    df = df.withColumn("recency_moved", recency).withColumn("decided", F.coalesce(decided, F.lit(False)))
    refused = F.when(w("trust") < TRUST_FLOOR, F.lit("both values are weakly evidenced")).otherwise(F.lit("trust is too close to choose"))
    status = (
        F.when(F.col("sides") == 1, "settled").when(F.col("decided") & (F.col("value_rank") == 1), "accepted")
        .when(F.col("decided") & F.col("recency_moved"), "superseded").otherwise("disputed")
    )
    rationale = F.when(F.col("sides") > 1, F.when(F.col("decided"), reason).otherwise(refused))
    told = lambda side: F.when(F.col("sides") > 1, F.struct(*(F.col(f"{side}.{c}").alias(c) for c in ("claim_id", "subject", "object_value", "asserted_at", "trust")))).alias(side)
    return df.select(*claims.columns, "subject_key", "value_key", "trust", "place", "value_rank", "sides", "decided", status.alias("status"), rationale.alias("rationale"), told("winner"), told("runner"))


def disagreements(arbitrated: DataFrame, subjects: bool = False) -> DataFrame:
    """One row for each group whose competing values come from two documents at least, with its weight; with ``subjects`` as the winner and the runner-up word them."""
    df = arbitrated.where("sides > 1").groupBy(*GROUP).agg(
        F.max("sides").cast("bigint").alias("sides"), F.count("*").alias("claims"), F.size(F.collect_set("doc_id")).cast("bigint").alias("documents"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"),
        F.size(F.collect_set("source")).alias("n_sources"), F.first("winner").alias("w"), F.first("runner").alias("r"), F.max("decided").alias("decided"), F.first("rationale").alias("rationale"),
        F.coalesce(F.min(F.when(F.col("asserted_at") != "", F.col("asserted_at"))), F.lit("")).alias("first_asserted"), F.max("asserted_at").alias("last_asserted"),
    ).where("documents >= 2")
    weight = F.col("claims") * (1 + F.col("n_sources")) * (1.0 + F.least("w.trust", "r.trust")) * F.when(F.col("decided"), 1.0).otherwise(2.0)
    return df.select(
        F.concat_ws("|", *GROUP).alias("key"), *GROUP, "sides", "claims", "documents", "sources", rounded(F.col("w.trust") - F.col("r.trust")).alias("trust_gap"), "decided",
        F.col("w.object_value").alias("winner_value"), F.col("w.claim_id").alias("winner_claim_id"), F.col("w.trust").alias("winner_trust"),
        F.col("r.object_value").alias("runner_value"), F.col("r.claim_id").alias("runner_claim_id"), F.col("r.trust").alias("runner_trust"),
        "first_asserted", "last_asserted", rounded(weight, 3).alias("weight"), "rationale", *([F.col("w.subject").alias("winner_subject"), F.col("r.subject").alias("runner_subject")] if subjects else []),
    )


def disagreement_map(found: DataFrame, limit: int = 40, predicate: str | None = None, scope: str | None = None, undecided: bool = False) -> DataFrame:
    """The heaviest disagreements, filtered."""
    if predicate is not None:
        found = found.where(F.col("predicate") == predicate)
    if scope is not None:
        found = found.where(F.col("scope") == scope)
    if undecided:
        found = found.where(~F.col("decided"))
    return found.orderBy(F.desc("weight"), "key").limit(limit)


def described(arbitrated: DataFrame) -> DataFrame:
    """(scope, text): what the claims of a scope come to, a line for each value: agreeing claims are one line with their sources; then why, where values compete."""
    value = arbitrated.groupBy(*GROUP, "value_rank").agg(
        F.min_by("object_value", "place").alias("value"), F.min_by("status", "place").alias("status"), F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"), F.first("rationale").alias("why"))
    line = F.concat(F.col("subject_key"), F.lit(" "), F.col("predicate"), F.lit(": "), F.col("value"), F.lit(" ["), F.col("status"), F.lit("; "), F.col("sources"), F.lit("]"))
    line = F.when((F.col("value_rank") == 1) & F.col("why").isNotNull(), F.concat(line, F.lit(" because "), F.col("why"))).otherwise(line)
    rows = value.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("subject_key", "predicate", "value_rank", line.alias("line")))).alias("lines"))  # the claims of one work item
    return rows.select("scope", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


def abstains(arbitrated: DataFrame) -> DataFrame:
    """(scope, abstains): whether some group of a scope has competing values and no decision."""
    return arbitrated.groupBy("scope").agg(F.max((F.col("sides") > 1) & ~F.col("decided")).alias("abstains"))


def disagreeing(arbitrated: DataFrame) -> DataFrame:
    """The claims of disagreements: of groups whose competing values come from two documents at least."""
    return arbitrated.where("sides > 1").withColumn("two", F.size(F.collect_set("doc_id").over(Window.partitionBy(*GROUP)))).where("two >= 2").drop("two")


def disagreement_sides(arbitrated: DataFrame) -> DataFrame:
    """Every claim of every disagreement with its side, sides in the order of their best trust."""
    return disagreeing(arbitrated).select(F.concat_ws("|", *GROUP).alias("key"), "claim_id", F.col("value_rank").cast("bigint").alias("side"), F.max("trust").over(Window.partitionBy(*GROUP, "value_key")).alias("side_trust"), "trust", "status")


def contradicts(arbitrated: DataFrame) -> DataFrame:
    """Each claim against each claim of another side, in both directions: every claim beside those of its group, so groups are dealt out once."""
    own = arbitrated.where("sides > 1").where(F.concat(*GROUP).isNotNull()).select(*GROUP, "claim_id", "value_rank", "trust", "decided")
    group = F.collect_list(F.struct(F.col("claim_id").alias("dst"), F.col("value_rank").alias("rank"), "trust")).over(Window.partitionBy(*GROUP))
    pairs = own.withColumn("group", group).withColumn("other", F.explode("group")).where("value_rank <> other.rank")
    return pairs.select(F.col("claim_id").alias("src"), F.col("other.dst").alias("dst"), "predicate", "scope", "decided", rounded(F.abs(F.col("trust") - F.col("other.trust"))).alias("gap"))


def days_between(a: Column, b: Column) -> Column:
    """365 days a year and 30 a month; 0 if either is no date."""
    part = lambda d, at, n: F.substring(d, at, n).cast("int")
    gap = F.abs(365 * (part(a, 1, 4) - part(b, 1, 4)) + 30 * (part(a, 6, 2) - part(b, 6, 2)) + part(a, 9, 2) - part(b, 9, 2))
    return F.coalesce(F.when(day(a).isNotNull() & day(b).isNotNull(), gap), F.lit(0)).cast("bigint")


def supersedes(arbitrated: DataFrame) -> DataFrame:
    """Winner to each claim that recency outdated."""
    return arbitrated.where("status = 'superseded'").select(F.col("winner.claim_id").alias("src"), F.col("claim_id").alias("dst"), days_between(F.col("winner.asserted_at"), F.col("asserted_at")).alias("days"), "predicate")
