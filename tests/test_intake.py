import pytest

from loomstead.operators import claims as C
from loomstead.sources import intake
from loomstead.streaming.intake import stream

FILES = {
    "slack/dsid_0a1__2151234567-gha-eval.txt": "gha-eval\nmaya: look at @tom.b and @deploy-bot in #infra-x\ntom.b: ok\nmaya: mail me@x.com",
    "gmail/inbox/dsid_0a2__note.txt": "A note\n\nFrom: Maya Chen <maya.chen@Red.com>\nTo: tom@red.com\nDate: Wed, 14 May 2025\n\nHello there",
    "fireflies/dsid_0a3__2025-06-12-review.txt": "Review\nDate: 2025-06-13\nAttendees (Cascade Group): Priya Nair, Daniel Cho\nAttendees (as recorded): Markus Li\n[00:13] Priya Nair: Thanks Markus.\nNaomi Feldman - Send the list",
    "jira/dsid_0a4__SUP-359481-broken.txt": "Broken\\nfirst\\nsecond",
    "google_drive/a/b/odd name.txt": "\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("corpus")
    for name, text in FILES.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text)
    return str(top)


def test_documents(spark, root, tmp_path):
    got = {r.source: r for r in intake.documents(spark, root).collect()}
    s, g, f, j, d = (got[k] for k in ("slack", "gmail", "fireflies", "jira", "google_drive"))
    assert (s.doc_id, s.thread_id, s.speakers, s.mentions, s.bots, s.channels, s.emails) == ("dsid_0a1", "2151234567", ["maya", "tom.b"], ["tom.b"], ["deploy-bot"], ["gha-eval", "infra-x"], ["me@x.com"])
    assert g.headers == {"from": "Maya Chen <maya.chen@Red.com>", "to": "tom@red.com", "date": "Wed, 14 May 2025"} and g.body == "Hello there" and g.folders == ["inbox"]
    assert [tuple(x) for x in g.named_emails] == [("Maya Chen", "maya.chen@red.com")] and g.date == "Wed, 14 May 2025"
    assert [tuple(x) for x in f.attendees] == [("Priya Nair", "Cascade Group"), ("Daniel Cho", "Cascade Group"), ("Markus Li", "")]
    assert f.speakers == ["Priya Nair", "Naomi Feldman"] and f.date == "2025-06-12"
    assert j.ticket_key == "SUP-359481" and j.body == "first\nsecond"
    assert (d.title, d.body, d.folders) == ("", "", ["a", "b"]) and d.slug.startswith("odd") and d.doc_id == d.slug
    intake.write(intake.documents(spark, root), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    assert intake.statistics(intake.documents(spark, root)).where("source IS NULL").first().documents == 5


def test_stream(spark, root, tmp_path):
    q = stream(spark, root).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("arrived").count() == 5


def test_run_writes_documents_statistics_and_what_was_left_out(spark, root, tmp_path):
    from pathlib import Path

    (Path(root) / "astray.txt").write_text("no source")
    totals, left_out = intake.run(spark, root, str(tmp_path))
    assert totals.where("source IS NULL").first().documents == 5
    assert {(r.path.rsplit("/", 1)[-1].replace("%20", " "), r.reason) for r in left_out.collect()} == {("astray.txt", "no source folder"), ("odd name.txt", "empty")}
    docs = intake.scan(spark, str(tmp_path / "documents"), ["slack", "jira", "none"], longest=5)
    assert {r.source: len(r.body) for r in docs.collect()} == {"slack": 5, "jira": 5}
    assert intake.scan(spark, str(tmp_path / "documents"), skip=1).count() == 0 and intake.scan(spark, str(tmp_path / "documents"), limit=1).count() == 5
    (Path(root) / "astray.txt").unlink()


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\nnot JSON\n')
    assert [tuple(r) for r in intake.json_rows(spark, [str(tmp_path / "a.jsonl")], "a int, b string").collect()] == [(1, "x"), (2, None), (None, None)]


def passages(spark, *texts):
    return spark.createDataFrame([(f"d{i}", "jira", "2025-01-01", "S", t) for i, t in enumerate(texts, 1)], "doc_id string, source string, asserted_at string, scope string, passage string")


def test_claims_of_a_batch_count_documents_from_one(spark):
    """A well-formed reply about the first document is a claim of it; provenance is the document's."""
    reply = '{"claims": [{"document": 1, "subject": " audit-log shipper ", "predicate": "owner", "object_value": "Priya Nair", "confidence": 0.9, "source": "made up"}, {"document": "2", "subject": "x", "predicate": "owner", "object_value": "Priya Nair", "confidence": 1}, {"document": 0, "subject": "y", "predicate": "owner", "object_value": "Priya Nair", "confidence": 1}]}'
    got = C.extract(passages(spark, "The audit-log shipper is owned by Priya Nair.", "Nobody is named here."), lambda texts: reply).collect()
    assert [(r.doc_id, r.source, r.asserted_at, r.subject, r.object_value) for r in got] == [("d1", "jira", "2025-01-01", "audit-log shipper", "Priya Nair")]


def test_claims_are_validated(spark):
    text = "Vault is owned by Maya Chen. Job-7 status: shipped. Tom Li reports to Maya Chen. Job-7 due 2025-01-02. Rate limit 30%"
    assert sorted(r.predicate for r in C.extract(passages(spark, text)).collect()) == ["due_date", "limit", "owner", "reports_to", "status"]
    fenced = '```json {"claims": [{"document": "1", "subject": "Job-7", "predicate": "status", "object_value": "Shipped!", "confidence": "0.4"}, {"document": 1, "subject": "b", "predicate": "status", "object_value": "shipped", "confidence": 7}, "text"]} ```'
    assert [(r.object_value, r.extractor_confidence) for r in C.extract(passages(spark, text), lambda _: fenced).collect()] == [("Shipped!", 0.4)]


def test_outages_are_not_cached_and_empty_replies_are(spark):
    df = passages(spark, "Vault is owned by Maya Chen.")
    broken, prose, nothing = (C.replies(df, f, "1") for f in (lambda _: 1 / 0, lambda _: "not JSON", lambda _: '{"claims": []}'))
    assert C.to_cache(broken).count() == 0 and C.to_cache(prose).count() == 0 and C.to_cache(nothing).count() == 1
    assert C.validated(broken).count() == 0 and [(r.doc_id, r.claims) for r in C.scanned(nothing).collect()] == [("d1", 0)]
    assert C.to_scan(df, C.scanned(nothing)).count() == 0 and C.to_scan(df, C.scanned(prose)).count() == 1
    cached = C.to_cache(C.replies(df, C.by_rules, "1"))
    assert C.extract(df, lambda _: 1 / 0, "1", cached).count() == 1 and C.extract(df, lambda _: 1 / 0, "2", cached).count() == 0


def test_one_repair_and_no_more():
    calls = []
    assert C.asked(lambda t: calls.append(1) or '{"claims": [', ["a"]) is None and len(calls) == 2
    replies = iter(["prose", '{"claims": [{"document": 1}]}'])
    assert C.asked(lambda t: next(replies), ["a"]) == [{"document": 1}]


def test_claims_of_work_items(spark):
    picked = spark.createDataFrame([("SUP-1", 1, "a"), ("SUP-1", 2, "b")], "key string, n long, doc_id string")
    docs = spark.createDataFrame([("a", "jira", "2025-01-01", "Vault is owned by Maya Chen."), ("b", "slack", "", "Vault is owned by Tom Li.")], "doc_id string, source string, date string, passage string")
    assert {(r.scope, r.object_value) for r in C.extract_work_items(picked, docs).collect()} == {("SUP-1", "Maya Chen"), ("SUP-1", "Tom Li")}
