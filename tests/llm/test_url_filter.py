from loomstead.llm.url_filter import RULES, judge

LISTED = "rule_host string, rule_path string, rule_verdict string"


def test_longest_rule_wins_and_odd_urls(spark):
    urls = [None, "", "x", "http://", "HTTP://WWW.Example.COM/en/7?q", "https://a.com/en/1#f", "https://example.com?/en/7", "ftp://example.net/de/81", "s://b.net/de/", "s://xnet/de/", "s://o.org/es", "s://o.org/es/", "s://com/en/"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, "s://com/en/", "x")], "page_id long, url string, host string")
    got = {r.page_id: tuple(r)[1:] for r in judge(df, spark.createDataFrame(RULES, LISTED)).collect()}
    none = (None, "allow")
    assert got == {
        0: ("", "", *none), 1: ("", "", *none), 2: ("", "", *none), 3: ("", "", *none), 4: ("www.example.com", "/en/7", "example.com/en/7", "allow"), 5: ("a.com", "/en/1", "com/en/", "block"),
        6: ("example.com", "", *none), 7: ("example.net", "/de/81", "example.net/de/8", "block"), 8: ("b.net", "/de/", "net/de/", "allow"), 9: ("xnet", "/de/", *none), 10: ("o.org", "/es", *none),
        11: ("o.org", "/es/", "org/es/", "block"), 12: ("com", "/en/", "com/en/", "block"), None: ("com", "/en/", "com/en/", "block"),
    }


def test_empty_list_and_table(spark):
    none = spark.createDataFrame([], LISTED)
    df = spark.createDataFrame([(1, "s://h/p")], "page_id long, url string")
    assert [tuple(r) for r in judge(df, none).collect()] == [(1, "h", "/p", None, "allow")]
    assert judge(df.limit(0), spark.createDataFrame(RULES, LISTED)).collect() == []


def test_many_listed(spark):
    listed = spark.range(2000).selectExpr("concat('h', id, '.org') AS rule_host", "'/' AS rule_path", "'block' AS rule_verdict")
    df = spark.range(4000).selectExpr("id AS page_id", "concat('http://w.h', id, '.org/x') AS url")
    assert judge(df, listed).where("verdict = 'block'").count() == 2000
