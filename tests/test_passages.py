from pyspark.sql import functions as F

from loomstead.operators import passages as P


def test_short_bodies_stay_whole_and_long_ones_keep_both_ends_and_the_answer(spark):
    body = "start " * 300 + "the needle is here " + "filler " * 600 + "the end"
    rows = spark.createDataFrame([(1, "short", ["x"]), (2, body, ["needle"]), (3, None, [])], "id int, body string, terms array<string>")
    got = {r.id: r.passage for r in P.select_passages(rows, 1600).collect()}
    assert got[1] == "short" and got[3] == ""
    assert got[2].startswith("start ") and got[2].endswith("the end") and "needle" in got[2] and len(got[2]) <= 1600 + 2 * len(P.GAP)


def test_spans_do_not_overlap_and_fit():
    body = " ".join(f"w{i % 97}" for i in range(4000))
    spans = P.chosen(body, ["w5", "w50"], 3000)
    assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:])) and sum(b - a for a, b in spans) <= 3000


def test_citations_and_report(spark):
    df = spark.createDataFrame([("a [2] b 【1】 [2] [x]", "T", "slack", "")], "a string, t string, s string, d string")
    r = df.select(P.citations(F.col("a")).alias("n"), P.cite(F.col("t"), F.col("s"), F.col("d")).alias("c")).first()
    assert (r.n, r.c) == ([1, 2], "T (slack)")
    facts = spark.createDataFrame([("x", 1, 1, False, 2.0), ("x", 1, 1, False, 2.0), ("x", 2, 0, True, 4.0), ("y", 3, 1, False, 9.0)], "kind string, qid int, supported int, abstained boolean, seconds double")
    got = {r.kind: tuple(r)[1:] for r in P.graded(facts).collect()}
    assert got == {"x": (2, 3, 2, 1, 1, 3.0, 2.0), "y": (1, 1, 1, 1, 0, 9.0, 9.0), None: (3, 4, 3, 2, 1, 4.0, 4.0)}
    assert P.abstains("NOT_IN_CORPUS.") and not P.abstains("")


def test_without_a_matching_term_the_head_gets_what_the_tail_leaves():
    body = "word " * 2000
    (a, b), (c, d) = P.chosen(body, ["absent"], 1600)
    assert a == 0 and d == len(body) and 1600 - (d - c) - 10 <= b <= 1600 - 400 and b - a + d - c <= 1600
