from pyspark.sql import functions as F

from loomstead.operators import arbitrate as A

CLAIM = "claim_id string, subject string, predicate string, object_value string, doc_id string, source string, asserted_at string, extractor_confidence double, scope string"


def claims(spark, *rows):
    return spark.createDataFrame([(f"c{i}", *r[:2], r[2], f"d{i}", r[3], r[4], 0.9, "S") for i, r in enumerate(rows)], CLAIM)


def judged(spark, *rows):
    return {r.claim_id: r for r in A.arbitrate(claims(spark, *rows)).collect()}


def test_newer_status_wins_and_outdates(spark):
    got = judged(spark, ("the job", "status", "blocked", "confluence", "2026-01-05"), ("Job", "status", "shipped", "slack", "2026-04-02"))
    assert (got["c0"].trust, got["c1"].trust) == (0.528, 0.672)
    assert (got["c0"].status, got["c1"].status) == ("superseded", "accepted") and "asserted later" in got["c1"].rationale


def test_too_close_is_refused(spark):
    got = judged(spark, ("job", "status", "a b", "confluence", "2026-01-05"), ("job", "status", "c d", "github", "2026-01-05"))
    assert {r.status for r in got.values()} == {"disputed"} and (got["c0"].trust, got["c1"].trust) == (0.96, 0.9408)


def test_agreement_wins_where_recency_has_no_weight(spark):
    got = judged(spark, ("ann", "reports_to", "Bo", "confluence", "2026-01-01"), ("ann", "reports_to", "bo.", "github", "2026-01-02"), ("ann", "reports_to", "cy", "slack", "2026-05-01"))
    assert [got[f"c{i}"].trust for i in range(3)] == [1.0, 1.0, 0.672]
    assert [got[f"c{i}"].status for i in range(3)] == ["accepted", "accepted", "disputed"] and "later" not in got["c0"].rationale


def test_values_and_subjects_are_normalised(spark):
    df = spark.createDataFrame([("30 percent", "The audit-log shipper"), ("30 %", "audit log  shipper"), ("30%.", "An Audit log shipper!"), ("30 per cent", "audit log shipper")], "v string, s string")
    got = df.select(A.value_key(F.col("v")).alias("v"), A.subject_key(F.col("s")).alias("s")).distinct().collect()
    assert [tuple(r) for r in got] == [("30%", "audit log shipper")]


def test_fold(spark):
    values = ["resolved", "sup 1 is resolved", "not resolved", "20", "120", "20 units", "liam", "liam maria", "liam maria joe"]
    got = spark.createDataFrame([(values,)], "v array<string>").select(A.fold(F.col("v")).alias("m")).first().m
    assert got == {v: v for v in values} | {"sup 1 is resolved": "resolved", "liam maria": "liam", "liam maria joe": "liam"}


def test_a_disagreement_needs_two_documents(spark):
    rows = claims(spark, ("job", "status", "a", "slack", ""), ("job", "status", "b", "jira", "")).withColumn("doc_id", F.lit("same"))
    assert A.disagreements(A.arbitrate(rows)).count() == 0 and A.contradicts(A.arbitrate(rows)).count() == 2


def test_empty(spark):
    assert A.disagreements(A.arbitrate(claims(spark, ("a", "b", "c", "d", "")).limit(0))).count() == 0
