from loomstead.operators import identity as I
from loomstead.operators import priors as P
from loomstead.plans import people


def test_stated_names_and_addresses_without_a_common_block_are_merged(spark, tmp_path):
    rows = [(33, "maya chen", "Brand#11"), (3, "ana silva", "Brand#12"), (66, "li wei", "Brand#13"), (99, "bo dahl", "Brand#13")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    got = sorted((r.name, r.forms) for r in people.entities(spark, str(tmp_path)).collect())
    assert got == [("ana silva", 2), ("maya chen", 2)]


def test_a_stated_binding_needs_no_common_block(spark):
    seen = spark.createDataFrame([("name", "Ann Lee", None, 1), ("email", "zz@mail.red.com", None, 1)], "kind string, value string, org string, doc_id int")
    links = I.hard_links(spark.createDataFrame([("ann lee", "zz@mail.red.com")], "name string, email string"))
    found = I.surfaces(seen)
    assert {r.value: r.org for r in found.collect()} == {"ann lee": None, "zz@mail.red.com": "red"}
    assert I.candidate_pairs(found).count() == 0
    scores = I.scored(I.candidate_pairs(found, links), found, links)
    assert [(r.score, r.signals) for r in scores.collect()] == [(0.99, "STATED_BINDING")]
    got = I.canonical(I.entities(scores, found), found, I.accepted(scores, I.entities(scores, found))).collect()
    assert [(r.eid, r.name, r.forms, r.confidence) for r in got] == [("ent_000001", "ann lee", 2, 0.99)]


def test_numbers_follow_occurrences(spark):
    rows = spark.range(3000).selectExpr("concat('e', lpad(id, 5, '0')) AS entity", "cast(id % 7 as bigint) AS occurrences")
    got = I.numbered(rows).orderBy("number").collect()
    assert [r.number for r in got] == list(range(1, 3001)) and [(-r.occurrences, r.entity) for r in got] == sorted((-r.occurrences, r.entity) for r in got)


def test_functional_mailboxes_are_no_persons(spark):
    mails = spark.createDataFrame([(f"{m}@o{i}.com",) for m in ("billing", "mchen", "elena.rossi") for i in range(3)], "email string")
    people = spark.createDataFrame([("chen",), ("elena",), ("rossi",)], "token string")
    assert [r.local for r in P.functional(mails, people).collect()] == ["billing"]
