"""Files of a corpus made of customers and orders, and the queries of intake over them: what was put into a file must come out of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims as C
from ..operators import passages as P
from ..sources import intake


def _who(spark: SparkSession, sf: str) -> DataFrame:
    who = spark.read.parquet(f"{sf}/customer.parquet").join(spark.read.parquet(f"{sf}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"))
    digits = F.regexp_extract("c_name", "([0-9]+)$", 1)
    return who.select(F.col("c_custkey").alias("k"), digits.alias("g"), F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))).alias("n"), F.lower("c_mktsegment").alias("seg"), F.hex("c_custkey").alias("h"))


def _parsed(rows: DataFrame, path, raw) -> DataFrame:
    return intake.parse(rows.select(path.alias("path"), raw.alias("raw")), "/data/corpus")


def _joined(column: str):
    return F.array_join(column, "|").alias(column)


def _text(template: str):
    """The template with {name} as columns."""
    parts = template.replace("}", "{").split("{")
    return F.concat(*(F.col(p) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def gmail(spark, sf):
    """Mail: headers, the address with its name, the body without its headers, folders."""
    path = _text("file:/data/corpus/gmail/{n}/{seg}/dsid_ab{k}__20250514-note-{g}.txt")
    raw = _text("\nNote {g}\n\nFrom: Ann Lee O'Hara <Ann.{g}@Mail.com>\nTo: bob{g}@x.com\nDate: Wed, 14 May 2025\nSubject: Re: {seg}\n\nHello {n},\nsee bob{g}@x.com")
    named = F.array_join(F.transform("named_emails", lambda p: F.concat(p["name"], F.lit("/"), p["email"])), "|")
    heads = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
    return _parsed(_who(spark, sf), path, raw).select("doc_id", "source", "slug", "title", "body", "date", "thread_id", _joined("folders"), _joined("emails"), named.alias("named_emails"), heads.alias("headers"))


def slack(spark, sf):
    """Chat: channel, speakers, mentions and bots, thread."""
    path = _text("file:/data/corpus/slack/dsid_cd{k}__2151234567-talk-{g}.txt")
    raw = _text("{n}\\n\\nmaya{g}: look at @tom{g} and @deploy-bot in #infra-{k}\\nNote: no speaker\\nci: @ci\\nmaya{g}: write a@b.com in #infra-{k}")
    return _parsed(_who(spark, sf), path, raw).select("doc_id", "thread_id", "title", "date", _joined("speakers"), _joined("mentions"), _joined("bots"), _joined("channels"))


def fireflies(spark, sf):
    """Calls: turns, attendees with their organisation, owners of actions, the date of the name."""
    path = _text("file:/data/corpus/fireflies/dsid_ef{k}__2025-06-12-review-{g}.txt")
    raw = _text("Review {g}\nDate: 2025-06-13\nAttendees (Group {g}): Priya Nair, Daniel Cho\nAttendees (as recorded): Markus Li\n[00:13] Priya Nair: Thanks {n}.\n[01:02:03] Ana {k}: ok\nNaomi Feldman - Send {seg}")
    guests = F.array_join(F.transform("attendees", lambda a: F.concat(a["name"], F.lit("/"), a["org"])), "|")
    return _parsed(_who(spark, sf), path, raw).select("doc_id", "title", "date", _joined("speakers"), guests.alias("attendees"))


def tickets(spark, sf):
    """Tickets: key, the stated date, hashtags; and names that aren't of the corpus's form."""
    path = F.when(F.col("k") % 2 == 0, _text("file:/data/corpus/jira/dsid_0{k}__sup-{k}-broken.txt")).otherwise(_text("file:/data/corpus/jira/a/odd {g}.txt"))
    raw = _text("Broken {g}\\nfirst\\nDate: 2024-02-03\\n#tag-{k} and user@x.com@nobody")
    return _parsed(_who(spark, sf), path, raw).select("doc_id", "slug", "title", "body", "ticket_key", "date", _joined("channels"), _joined("folders"), _joined("mentions"))


def statistics(spark, sf):
    rows = _who(spark, sf)
    path = F.when(F.col("k") % 3 == 0, _text("file:/data/corpus/jira/dsid_0{k}__sup-{k}-broken.txt")).otherwise(_text("file:/data/corpus/slack/dsid_0{k}__2151234567-talk.txt"))
    return intake.statistics(_parsed(rows, path, _text("{n}\nmaya: @tom in #x-{k} a@b.com")))


def bots(spark, sf):
    """Handles that are no persons, by their shape."""
    k = F.col("k") % 8
    handle = F.get(F.array(*map(F.lit, ("ci", "deploy-x", "ann", "my_bot", "robot", "no-reply", "ops_1", "devops"))), k.cast("int"))
    return _who(spark, sf).select("k", handle.alias("handle"), handle.rlike(intake.BOT).alias("bot"))


def claims_read(spark, sf):
    """Claims that the offline extractor finds in texts made of customers, in batches of one scope."""
    text = _text("Vault {g} is owned by Maya Chen. Job-{k} status: shipped. Job-{k} due 2025-01-02. Rate {k} limit 30%")
    rows = _who(spark, sf).select(F.concat(F.lit("d"), "k").alias("doc_id"), F.lit("jira").alias("source"), F.lit("2025-01-01").alias("asserted_at"), F.concat(F.lit("S"), F.col("k") % 7).alias("scope"), text.alias("passage"))
    return C.extract(rows).select("doc_id", "scope", "subject", "predicate", "object_value", "asserted_at", "extractor_confidence")


def claims_validated(spark, sf):
    """A reply with one good claim and others that aren't: each breaks one rule."""
    claim = lambda s, p, v, c: F.struct(F.lit("1").alias("document"), s.alias("subject"), F.lit(p).alias("predicate"), v.alias("object_value"), F.lit(c).alias("confidence"))
    own = F.concat(F.lit(" Job "), "g", F.lit(" "))
    reply = F.to_json(F.array(claim(own, "owner", F.concat(F.lit("Maya "), "g"), "0.4"), claim(own, "owner", F.lit("Nobody"), "0.9"), claim(own, "mood", F.lit("Maya"), "0.9"), claim(own, "status", F.lit("shipped"), "7"),
                              claim(F.lit(""), "status", F.lit("shipped"), "1"), claim(own, "status", F.lit("..."), "1"), claim(F.repeat(F.lit("x"), 121), "status", F.lit("shipped"), "1"), claim(own, "status", F.lit("Shipped!"), "high")))
    rows = _who(spark, sf).select(F.concat(F.lit("d"), "k").alias("doc_id"), F.lit("jira").alias("source"), F.lit("Tue, 10 Jun 2025").alias("asserted_at"), F.lit("S").alias("scope"), F.concat(F.lit("maya "), "g", F.lit(" shipped it")).alias("passage"), reply.alias("reply"))
    return C.validated(rows).select("claim_id", "doc_id", "subject", "object_value", "asserted_at", "extractor_confidence")


def passages_chosen(spark, sf):
    """How many characters of each long text are kept, and whether both ends are: spans fit the budget whatever the question."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.trim(F.coalesce("text", F.lit(""))).alias("body"))
    got = P.select_passages(docs.withColumn("terms", F.array(F.lit("the"), F.lit("on"))), 1600)
    return got.select("doc_id", (F.length("body") <= 1600).alias("short"), (F.length("passage") <= 1600 + 3 * F.size(F.split("passage", " … "))).alias("fits"), (F.left("passage", F.lit(20)) == F.left("body", F.lit(20))).alias("head"))


def grades(spark, sf):
    """Answers of an order's lines as facts: how many are supported, and how long it took."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    facts = lines.select(F.col("l_returnflag").alias("kind"), F.concat_ws("-", "l_orderkey", "l_returnflag").alias("qid"), (F.col("l_linenumber") % 2).cast("long").alias("supported"), (F.col("l_orderkey") % 10 == 0).alias("abstained"), (F.col("l_orderkey") % 100).cast("double").alias("seconds"))
    return P.graded(facts)


WHO = """WITH w AS (SELECT c_custkey AS k, regexp_extract(c_name, '([0-9]+)$', 1) AS g, lower(replace(n_name, '_', '-')) AS n, lower(c_mktsegment) AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""
QUERIES = {
    "intake_gmail": (gmail, WHO + """SELECT 'dsid_ab' || k AS doc_id, 'gmail' AS source, '20250514-note-' || g AS slug, 'Note ' || g AS title, 'Hello ' || n || ',' || chr(10) || 'see bob' || g || '@x.com' AS body, 'Wed, 14 May 2025' AS date, '20250514' AS thread_id,
      n || '|' || seg AS folders, 'ann.' || g || '@mail.com|bob' || g || '@x.com' AS emails, 'Ann Lee O''Hara/ann.' || g || '@mail.com' AS named_emails,
      'date=Wed, 14 May 2025|from=Ann Lee O''Hara <Ann.' || g || '@Mail.com>|subject=Re: ' || seg || '|to=bob' || g || '@x.com' AS headers FROM w"""),
    "intake_slack": (slack, WHO + """SELECT 'dsid_cd' || k AS doc_id, '2151234567' AS thread_id, n AS title, '' AS date, 'maya' || g AS speakers, 'tom' || g AS mentions, 'deploy-bot|ci' AS bots, n || '|infra-' || k AS channels FROM w"""),
    "intake_fireflies": (fireflies, WHO + """SELECT 'dsid_ef' || k AS doc_id, 'Review ' || g AS title, '2025-06-12' AS date, 'Priya Nair|Ana ' || k || '|Naomi Feldman' AS speakers, 'Priya Nair/Group ' || g || '|Daniel Cho/Group ' || g || '|Markus Li/' AS attendees FROM w"""),
    "intake_tickets": (tickets, WHO + """SELECT CASE WHEN k % 2 = 0 THEN 'dsid_0' || k ELSE 'odd ' || g END AS doc_id, CASE WHEN k % 2 = 0 THEN 'sup-' || k || '-broken' ELSE 'odd ' || g END AS slug, 'Broken ' || g AS title,
      'first' || chr(10) || 'Date: 2024-02-03' || chr(10) || '#tag-' || k || ' and user@x.com@nobody' AS body, CASE WHEN k % 2 = 0 THEN 'SUP-' || k ELSE '' END AS ticket_key, '2024-02-03' AS date, 'tag-' || k AS channels, CASE WHEN k % 2 = 0 THEN '' ELSE 'a' END AS folders, '' AS mentions FROM w"""),
    "intake_statistics": (statistics, WHO + """, s AS (SELECT CASE WHEN k % 3 = 0 THEN 'jira' ELSE 'slack' END AS source, k % 3 = 0 AS j FROM w) SELECT source, count(*) AS documents, count(*) AS emails, count(*) FILTER (NOT j) AS speakers, count(*) AS mentions,
      CAST(sum(CASE WHEN j THEN 1 ELSE 2 END) AS BIGINT) AS channels, 0::BIGINT AS attendees, 0::BIGINT AS bots, count(*) FILTER (j) AS ticket_key, 0::BIGINT AS date, count(*) FILTER (NOT j) AS thread_id FROM s GROUP BY ROLLUP (source)"""),
    "bots": (bots, "SELECT c_custkey AS k, list_extract(['ci', 'deploy-x', 'ann', 'my_bot', 'robot', 'no-reply', 'ops_1', 'devops'], CAST(c_custkey % 8 AS INT) + 1) AS handle, c_custkey % 8 IN (0, 1, 3, 5, 6) AS bot FROM customer"),
    "claims_read": (claims_read, WHO + """, c AS (SELECT k, g, unnest(['owner', 'status', 'due_date', 'limit']) AS predicate, unnest(['Vault ' || g, 'Job-' || k, 'Job-' || k, 'Rate ' || k]) AS subject, unnest(['Maya Chen', 'shipped', '2025-01-02', '30%']) AS object_value FROM w)
      SELECT 'd' || k AS doc_id, 'S' || (k % 7) AS scope, subject, predicate, object_value, '2025-01-01' AS asserted_at, 0.9e0 AS extractor_confidence FROM c"""),
    "claims_validated": (claims_validated, WHO + "SELECT left(sha1('d' || k || '|owner|job' || g || '|maya' || g), 12) AS claim_id, 'd' || k AS doc_id, 'Job ' || g AS subject, 'Maya ' || g AS object_value, '2025-06-10' AS asserted_at, 0.4e0 AS extractor_confidence FROM w"),
    "passages_chosen": (passages_chosen, "SELECT doc_id, length(trim(coalesce(text, ''))) <= 1600 AS short, true AS fits, true AS head FROM documents"),
    "grades": (grades, """WITH a AS (SELECT l_returnflag AS kind, l_orderkey AS q, count(*) AS facts, sum(l_linenumber % 2)::BIGINT AS supported, (l_orderkey % 10 = 0)::INT AS abstained, CAST(l_orderkey % 100 AS DOUBLE) AS seconds FROM lineitem GROUP BY ALL)
      SELECT kind, count(*) AS answers, sum(facts)::BIGINT AS facts, sum(supported)::BIGINT AS supported, count(*) FILTER (facts = supported) AS perfect, sum(abstained)::BIGINT AS abstained, median(seconds) AS median_seconds,
        list_extract(list_sort(list(seconds)), greatest(CAST(floor(count(*) * 0.95e0) AS BIGINT) - 1, 0) + 1) AS p95_seconds FROM a GROUP BY ROLLUP (kind)"""),
}
