"""Results that only showed on larger or odder tables, and how the work is dealt out."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomstead.operators import retrieval as R
from loomstead.plans import claims

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter"), df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_capitals_of_two_letters(spark, tmp_path):
    table = tmp_path / "benchmark.parquet"
    duckdb.sql(f"COPY (SELECT * FROM (VALUES (1::BIGINT, 'Die Straße heißt so.'), (11, 'ñandú Äpfel'), (12, 'weiß')) v(item_id, text)) TO '{table}' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{table}'")
    want = con.execute(entry.oracle_sql()["question_grades"]).fetchall()
    got = entry.queries()["question_grades"](spark, str(tmp_path)).select("question_id", "text", "facts").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == 3


def test_arbitration_deals_lines_out_once(spark):
    """Titles that aren't read are not joined, and groups are met where the lines were dealt out by scope."""
    left, dealt = exchanges(entry.queries()["claim_vertices"](spark, "/root/testdata/sf0.01"))  # no id repeats there
    assert left == 0 and dealt == 1
    assert exchanges(entry.queries()["disagreements"](spark, "/root/testdata/sf0.01"))[1] == 1


def test_a_line_twice_is_one_claim(spark, tmp_path):
    for name in ("supplier", "lineitem"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        (df.union(df.where("l_orderkey < 40")) if name == "lineitem" else df).write.parquet(f"{tmp_path}/{name}.parquet")
    twice = claims.claims(spark, str(tmp_path))
    assert len(claims.parts(spark, str(tmp_path))) == 2
    assert sorted(twice.select("claim_id").collect()) == sorted(claims.claims(spark, SF).select("claim_id").collect())


def test_windows_of_a_body():
    body = "ab " * 400 + "zz"
    plain = {}
    for start in range(0, len(body), R.STEP):
        hits = [t for t in ("ab", "zz", "b a") if t in body[start : start + R.WINDOW]]
        if hits:
            plain[start] = (round(sum(1 / body.count(t) ** 0.5 for t in hits), 3), len(hits))
    got = {s: (round(score, 3), n) for _, s, score, n in R.weighed_windows(body, [(1, ["ab", "zz", "b a", "none"])])}
    assert got == plain


def test_postings_of_asked_terms(spark):
    docs = spark.createDataFrame([(1, "Red red", "a red fox", "x"), (2, "fox", "", "red x"), (2, "", "fox fox", "")], "doc_id long, title string, body string, facets string")
    whole = {tuple(r) for r in R.postings(docs).collect()}
    asked = docs.sparkSession.createDataFrame([("red",), ("none",)], "term string")
    assert {tuple(r) for r in R.postings(docs, of=asked).collect()} == {r for r in whole if r[0] == "red"} == {("red", 1, 9, 6), ("red", 2, 2, 5)}
    assert {tuple(r) for r in R.frequencies(docs).collect()} == {("red", 2), ("a", 1), ("fox", 2), ("x", 2)}
    assert R.mean_length(docs) == 5.5


def test_compounds_are_met_in_the_documents(spark):
    docs = spark.createDataFrame([(1, "audit log", "the audit-log, log audit", ""), (2, "log", "audit", "")], "doc_id long, title string, body string, facets string")
    terms = docs.sparkSession.createDataFrame([("audit-log",), ("log",)], "term string")
    got = R.compound_postings(terms, None, docs, R.frequencies(docs))
    assert [tuple(r) for r in got.collect()] == [("audit-log", 1, 5, 7)]
    assert "Join" not in got.select(F.lit(1)).where("false")._jdf.queryExecution().optimizedPlan().toString()
