from loomstead.operators import graph as G
from loomstead.operators import identity as I


def test_round_robin(spark):
    lists = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (1, 1, "b"), (1, 2, "c"), (2, 1, "a")], "list int, rank int, doc_id string")
    assert [r.doc_id for r in G.round_robin(lists).collect()] == ["a", "b", "c"]


def test_history_takes_the_longest_chain_and_stops(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(0, 5), (20, 21), (21, 20)], "src int, dst int")
    got = {r.root: r.path for r in G.history(edges).collect()}
    assert got == {0: [0, 1, 2, 3, 4, 5, 6]}


def test_exposure_is_strongest_role_once(spark):
    docs = spark.createDataFrame([("k", 1), ("k", 2)], "claim_id string, doc_id int")
    sent = spark.createDataFrame([(7, "Ann", 2)], "eid int, name string, doc_id int")
    named = spark.createDataFrame([(7, "Ann", 1), (8, "ann", 1), (9, "Bo", 1), (9, "Bo", 3)], "eid int, name string, doc_id int")
    got = sorted(tuple(r) for r in G.exposure(docs, [("sent", sent), ("named in", named)]).collect())
    assert got == [("k", "ann", 7, "sent"), ("k", "bo", 9, "named in")]


def test_endpoints_and_ambiguous_surfaces(spark):
    edges, nodes = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (4, 2)], "src int, dst int"), spark.createDataFrame([(1,), (2,)], "n int")
    assert [tuple(r) for r in G.existing(edges, nodes, nodes).collect()] == [(1, 2)]
    aliases = spark.createDataFrame([("e1", "name", "Ann"), ("e2", "name", "ann"), ("e1", "email", "a@x")], "eid string, kind string, surface string")
    asked = spark.createDataFrame([(1, "name", "ANN"), (1, "email", "a@x"), (2, "name", "bo")], "doc_id int, kind string, surface string")
    got = sorted((r.surface, r.outcome) for r in G.linked(asked, G.unique_lookup(aliases)).collect())
    assert got == [("a@x", "linked"), ("ann", "ambiguous"), ("bo", "unresolved")]


def test_clustering_refuses_two_organisations_and_mailboxes(spark):
    rows = [
        ("email:a.b@x.com", "name:a b", 0.95, "LOCAL_EQUALS_NAME"), ("email:a.b@y.com", "name:a b", 0.95, "LOCAL_EQUALS_NAME"),
        ("email:c.d@x.com", "name:c d", 0.99, "STATED_BINDING"), ("email:cd@x.com", "name:c d", 0.99, "STATED_BINDING"), ("email:q@x.com", "name:c d", 0.75, "UNIQUE_GIVEN_NAME"), ("handle:weak", "name:c d", 0.5, "x"),
    ]
    keys = sorted({k for r in rows for k in r[:2]})
    found = spark.createDataFrame([(k, k.split("@")[1].split(".")[0] if "@" in k else None) for k in keys], "key string, org string")
    got = {r.key: r.entity for r in I.entities(spark.createDataFrame(rows, "a string, b string, score double, signals string"), found).collect()}
    assert got["name:a b"] == got["email:a.b@x.com"] != got["email:a.b@y.com"]
    assert got["name:c d"] == got["email:c.d@x.com"] == got["email:cd@x.com"] != got["email:q@x.com"] and got["handle:weak"] == "handle:weak"
