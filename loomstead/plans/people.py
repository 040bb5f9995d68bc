"""People derived from parts (two-word names, brands as organisations), and the queries of identity over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import identity as I
from ..operators import priors as P
from ..sources.store import kept


def people(spark: SparkSession, sf: str) -> DataFrame:
    """A part is a person: a name, a handle of its initial and second word, and an address at its brand."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    first, last = F.split("p_name", " ")[0], F.element_at(F.split("p_name", " "), -1)
    org = F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "")
    local = F.when(F.col("p_partkey") % 11 == 0, "info").when(F.col("p_partkey") % 5 == 0, F.concat(F.left(first, F.lit(1)), last)).otherwise(F.concat_ws(".", first, last))
    return part.select(F.col("p_partkey").alias("doc_id"), F.lower("p_name").alias("name"), F.lower(F.concat(F.left(first, F.lit(1)), last)).alias("handle"), F.lower(F.concat(local, F.lit("@"), org, F.lit(".com"))).alias("email"), org.alias("org"))


def seen(spark, sf):
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("name", "handle", "email")])
    return people(spark, sf).select("doc_id", "org", F.inline(kinds))


class World:
    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf
        addresses, names = people(spark, sf).select("email"), people(spark, sf).select("name")
        self.home = kept(spark, sf, "home", lambda: P.home_labels(addresses))
        self.functional = kept(spark, sf, "functional", lambda: P.functional(addresses, names.select(F.explode(F.split("name", " ")).alias("token"))))
        self.links = kept(spark, sf, "links", lambda: I.hard_links(people(spark, sf).select("name", "email")))
        self.surfaces = kept(spark, sf, "surfaces", lambda: I.surfaces(seen(spark, sf), self.home, self.functional))
        self.working = kept(spark, sf, "working", lambda: I.working_set(self.surfaces, self.links, self.functional))

    def pairs(self):
        return kept(self.spark, self.sf, "pairs", lambda: I.candidate_pairs(self.working, self.links))

    def scores(self):
        return kept(self.spark, self.sf, "scores", lambda: I.scored(self.pairs(), self.working, self.links))

    def clustered(self):
        return kept(self.spark, self.sf, "clustered", lambda: I.entities(self.scores(), self.working))


def surface_counts(spark, sf):
    return World(spark, sf).surfaces.select("key", "count", "documents", "orgs", F.coalesce("org", F.lit("")).alias("org"), "is_functional")


def surface_sources(spark, sf):
    return I.counted_by(seen(spark, sf), "org")


def exclusive_links(spark, sf):
    w = World(spark, sf)
    return I.exclusive_links(w.links, w.functional)


def best_evidence(spark, sf):
    w = World(spark, sf)
    return I.best_evidence(w.clustered(), I.accepted(w.scores(), w.clustered())).select("key", "score", "signals")


def address_orgs(spark, sf):
    return P.org_of(people(spark, sf).select("email").distinct(), World(spark, sf).home)


def minded_names(spark, sf):
    """Names, some of them no names, as occurrences: what stays and as what."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    raw = F.when(F.col("p_partkey") % 4 == 0, F.element_at(F.split("p_name", " "), 1)).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("Meeting "), "p_name")).otherwise(F.concat(F.upper("p_name"), F.lit(" (QA)")))
    return I.minded(part.select(F.lit("name").alias("kind"), raw.alias("value"), F.col("p_partkey").alias("doc_id")))


def shared_mailboxes(spark, sf):
    w = World(spark, sf)
    return I.shared_mailboxes(w.links, w.functional)


def working_set(spark, sf):
    return World(spark, sf).working.select("key", "count")


def blocking_pairs(spark, sf):
    return World(spark, sf).pairs()


def dropped_blocks(spark, sf):
    return I.dropped_blocks(World(spark, sf).surfaces)


def pair_scores(spark, sf):
    return World(spark, sf).scores()


def signal_histogram(spark, sf):
    return World(spark, sf).scores().select(F.explode(F.split("signals", r"\|")).alias("signal")).groupBy("signal").agg(F.count("*").alias("pairs"))


def components(spark, sf):
    return I.minimum_labels(World(spark, sf).scores().where(F.col("score") >= I.THRESHOLD).select("a", "b"))


def entities(spark, sf):
    w = World(spark, sf)
    return I.canonical(w.clustered(), w.working, I.accepted(w.scores(), w.clustered()))


def resolution_stages(spark, sf):
    w = World(spark, sf)
    return I.diagnostics(w.surfaces, w.working, w.pairs(), w.scores(), w.clustered()).where("stage <> 'entities'")


def priors_home(spark, sf):
    return P.home_labels(people(spark, sf).select("email"))


def priors_functional(spark, sf):
    names = people(spark, sf).select(F.explode(F.split("name", " ")).alias("token"))
    return P.functional(people(spark, sf).select("email"), names)


def priors_qualifiers(spark, sf):
    """Names with a title behind those of every second part; titles are in no address."""
    titled = people(spark, sf).select(F.concat(F.col("name"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.get(F.array(*map(F.lit, ("ae", "lead", "müller"))), (F.col("doc_id") % 3).cast("int")))).otherwise("")).alias("name"))
    return P.qualifiers(titled, people(spark, sf).select("email").union(people(spark, sf).select(F.concat(F.lit("mueller."), "email"))))


SQL = r"""WITH RECURSIVE p AS (SELECT p_partkey AS doc_id, lower(p_name) AS name, lower(split_part(p_name, ' ', 1)) AS f, lower(split_part(p_name, ' ', -1)) AS l, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS org FROM part),
people AS (SELECT *, left(f, 1) || l AS handle, CASE WHEN doc_id % 11 = 0 THEN 'info' WHEN doc_id % 5 = 0 THEN left(f, 1) || l ELSE f || '.' || l END || '@' || org || '.com' AS email FROM p),
seen AS (SELECT doc_id, org, 'name' AS kind, name AS value FROM people UNION ALL SELECT doc_id, org, 'handle', handle FROM people UNION ALL SELECT doc_id, org, 'email', email FROM people),
surfaces AS (SELECT kind, value, kind || ':' || value AS key, count(*) AS count, count(DISTINCT doc_id) AS documents, count(DISTINCT org) AS orgs FROM seen GROUP BY kind, value),
mb AS (SELECT DISTINCT org AS label, split_part(email, '@', 1) AS local FROM people), hl AS (SELECT label FROM mb GROUP BY label ORDER BY count(*) DESC, label LIMIT 1),
rare AS (SELECT * FROM mb WHERE local IN (SELECT local FROM mb GROUP BY local HAVING count(*) <= 2)), oh AS (SELECT local FROM rare WHERE label IN (FROM hl)),
sh AS (SELECT label, count(*) AS n, count(*) FILTER (local IN (FROM oh)) AS shared FROM rare WHERE label NOT IN (FROM hl) GROUP BY label),
home AS (FROM hl UNION ALL SELECT label FROM sh WHERE shared >= 3 AND shared / least(n, (SELECT count(*) FROM oh)) >= 0.25),
nt AS (SELECT f AS t FROM p UNION SELECT l FROM p), ofn AS (SELECT local FROM mb GROUP BY local HAVING count(DISTINCT label) >= 3),
fn AS (SELECT DISTINCT local FROM (SELECT local, unnest(list_filter(regexp_split_to_array(local, '[^a-z]+'), lambda x: x <> '')) AS t FROM ofn) WHERE t NOT IN (FROM nt) AND NOT (length(t) > 2 AND substr(t, 2) IN (FROM nt))),
links AS (SELECT name, email, count(*) AS times FROM people GROUP BY ALL),
shared AS (SELECT email, count(DISTINCT name) AS names FROM links GROUP BY email HAVING names > 1 OR split_part(email, '@', 1) IN (FROM fn)),
bound AS (SELECT 'name:' || name AS key FROM links WHERE email NOT IN (SELECT email FROM shared) UNION SELECT 'email:' || email FROM links WHERE email NOT IN (SELECT email FROM shared)),
working AS (SELECT *, CASE WHEN kind = 'name' THEN string_split(value, ' ') ELSE list_filter(regexp_split_to_array(regexp_replace(split_part(value, '@', 1), '[0-9]+', '', 'g'), '[._\-\s]+'), lambda x: x <> '') END AS tokens
  FROM surfaces WHERE key NOT IN (SELECT 'email:' || email FROM shared) AND NOT (kind = 'email' AND split_part(value, '@', 1) IN (FROM fn)) AND (count >= 5 OR key IN (FROM bound))),
bk AS (SELECT DISTINCT key, unnest(list_filter([ 'compact:' || array_to_string(tokens, ''), CASE WHEN len(tokens) >= 2 THEN 'first:' || tokens[1] END, CASE WHEN len(tokens) >= 2 THEN 'last:' || tokens[-1] END,
  CASE WHEN len(tokens) >= 2 THEN 'init:' || left(tokens[1], 1) || '|' || tokens[-1] WHEN length(tokens[1]) > 2 THEN 'init:' || left(tokens[1], 1) || '|' || substr(tokens[1], 2) END ], lambda x: x IS NOT NULL)) AS block FROM working),
bn AS (SELECT block, key, count(*) OVER (PARTITION BY block) AS n FROM bk),
pairs AS (SELECT x.key AS a, y.key AS b FROM bn x JOIN bn y ON x.block = y.block AND x.key < y.key WHERE x.n BETWEEN 2 AND 240
  UNION SELECT least('name:' || name, 'email:' || email), greatest('name:' || name, 'email:' || email) FROM links WHERE 'name:' || name IN (SELECT key FROM working) AND 'email:' || email IN (SELECT key FROM working)),
full_names AS (SELECT array_to_string(tokens, '') AS form, tokens[1] AS given, left(tokens[1], 1) || '|' || tokens[-1] AS initial FROM working WHERE kind = 'name' AND len(tokens) >= 2),
go AS (SELECT given, min(form) AS o FROM full_names GROUP BY given HAVING count(DISTINCT form) = 1), io AS (SELECT initial, min(form) AS o FROM full_names GROUP BY initial HAVING count(DISTINCT form) = 1),
side AS (SELECT key, kind, array_to_string(tokens, '') AS c, len(tokens) AS n, tokens[1] AS g, tokens[-1] AS z, left(tokens[1], 1) || '|' || tokens[-1] AS i, go.o AS go, io.o AS io FROM working LEFT JOIN go ON tokens[1] = go.given LEFT JOIN io ON left(tokens[1], 1) || '|' || tokens[-1] = io.initial),
j AS (SELECT a, b, x.kind || '-' || y.kind AS k, x, y, CASE WHEN x.kind = 'name' THEN x ELSE y END AS nm, CASE WHEN x.kind = 'name' THEN y ELSE x END AS ot, EXISTS (FROM links WHERE least('name:' || name, 'email:' || email) = a AND greatest('name:' || name, 'email:' || email) = b) AS stated
  FROM pairs JOIN side x ON x.key = a JOIN side y ON y.key = b),
sig AS (SELECT a, b, stated, CASE
  WHEN k IN ('email-name', 'handle-name') AND nm.n >= 2 AND nm.c = ot.c THEN CASE k WHEN 'email-name' THEN 'LOCAL_EQUALS_NAME' ELSE 'HANDLE_EQUALS_NAME' END
  WHEN k IN ('email-name', 'handle-name') AND nm.n >= 2 AND ot.c = left(nm.g, 1) || nm.z AND nm.io = nm.c THEN 'INITIAL_SURNAME'
  WHEN k IN ('email-name', 'handle-name') AND nm.n >= 2 AND ot.n = 1 AND ot.c = nm.g AND nm.go = nm.c THEN 'UNIQUE_GIVEN_NAME'
  WHEN k = 'email-handle' AND x.c = y.c THEN 'HANDLE_EQUALS_LOCAL'
  WHEN k = 'name-name' AND x.c = y.c THEN 'NAME_EQUALS_NAME'
  WHEN k = 'name-name' AND x.n >= 2 AND y.n >= 2 AND x.i = y.i AND (length(x.g) = 1 OR length(y.g) = 1) AND (x.io IS NOT NULL OR y.io IS NOT NULL) THEN 'ABBREVIATED_NAME' END AS s FROM j),
scores AS (SELECT a, b, floor((1e0 - CASE WHEN stated THEN 1e0 - 0.99e0 ELSE 1e0 END * CASE s WHEN 'LOCAL_EQUALS_NAME' THEN 1e0 - 0.95e0 WHEN 'HANDLE_EQUALS_LOCAL' THEN 1e0 - 0.9e0 WHEN 'HANDLE_EQUALS_NAME' THEN 1e0 - 0.88e0 WHEN 'NAME_EQUALS_NAME' THEN 1e0 - 0.88e0
  WHEN 'INITIAL_SURNAME' THEN 1e0 - 0.72e0 WHEN 'ABBREVIATED_NAME' THEN 1e0 - 0.72e0 WHEN 'UNIQUE_GIVEN_NAME' THEN 1e0 - 0.75e0 ELSE 1e0 END) * 1e4 + 0.5e0) / 1e4 AS score, concat_ws('|', CASE WHEN stated THEN 'STATED_BINDING' END, s) AS signals FROM sig WHERE stated OR s IS NOT NULL)
"""
BOXES = r"""WITH p AS (SELECT p_partkey AS doc_id, lower(p_name) AS name, lower(split_part(p_name, ' ', 1)) AS f, lower(split_part(p_name, ' ', -1)) AS l, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS label FROM part),
m AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'info' WHEN doc_id % 5 = 0 THEN left(f, 1) || l ELSE f || '.' || l END AS local FROM p), own AS (SELECT DISTINCT label, local FROM m)
"""
QUERIES = {
    "surface_counts": (surface_counts, SQL + """SELECT key, count, documents, orgs, CASE WHEN kind <> 'email' THEN '' WHEN regexp_extract(value, '@([^.]+)', 1) IN (FROM home) THEN 'home' ELSE regexp_extract(value, '@([^.]+)', 1) END AS org,
      kind = 'email' AND split_part(value, '@', 1) IN (FROM fn) AS is_functional FROM surfaces"""),
    "surface_sources": (surface_sources, SQL + "SELECT kind || ':' || value AS key, org, count(*) AS count FROM seen GROUP BY ALL"),
    "exclusive_links": (exclusive_links, SQL + "SELECT * FROM links WHERE email NOT IN (SELECT email FROM shared)"),
    "address_orgs": (address_orgs, SQL + "SELECT DISTINCT email, CASE WHEN org IN (FROM home) THEN '' ELSE org END AS org FROM people"),
    "minded_names": (minded_names, """SELECT CASE WHEN p_partkey % 4 = 0 THEN 'handle' ELSE 'name' END AS kind, CASE WHEN p_partkey % 4 = 0 THEN lower(split_part(p_name, ' ', 1)) ELSE lower(p_name) END AS value, p_partkey AS doc_id FROM part WHERE p_partkey % 4 <> 1"""),
    "best_evidence": (best_evidence, None),
    "resolution_stages": (resolution_stages, SQL + """SELECT 'surfaces' AS stage, count(*) AS n FROM surfaces UNION ALL SELECT 'working', count(*) FROM working UNION ALL SELECT 'pairs', count(*) FROM pairs UNION ALL SELECT 'scored', count(*) FROM scores
      UNION ALL SELECT 'strong', count(*) FROM scores WHERE score >= 0.7e0"""),
    "shared_mailboxes": (shared_mailboxes, SQL + "SELECT * FROM shared"),
    "working_set": (working_set, SQL + "SELECT key, count FROM working"),
    "blocking_pairs": (blocking_pairs, SQL + "SELECT * FROM pairs"),
    "pair_scores": (pair_scores, SQL + "SELECT * FROM scores"),
    "signal_histogram": (signal_histogram, SQL + "SELECT signal, count(*) AS pairs FROM (SELECT unnest(string_split(signals, '|')) AS signal FROM scores) GROUP BY 1"),
    "components": (components, SQL + """, e AS (SELECT a, b FROM scores WHERE score >= 0.7e0 UNION SELECT b, a FROM scores WHERE score >= 0.7e0),
      r AS (SELECT a AS node, a AS seen FROM e UNION SELECT node, b FROM r JOIN e ON a = seen) SELECT node, min(seen) AS component FROM r GROUP BY node"""),
    "dropped_blocks": (dropped_blocks, None),
    "entities": (entities, None),
    "priors_home": (priors_home, BOXES + """, h AS (SELECT label FROM own GROUP BY label ORDER BY count(*) DESC, label LIMIT 1), rare AS (SELECT * FROM own WHERE local IN (SELECT local FROM own GROUP BY local HAVING count(*) <= 2)),
      oh AS (SELECT local FROM rare WHERE label IN (FROM h)), s AS (SELECT label, count(*) AS n, count(*) FILTER (local IN (FROM oh)) AS shared FROM rare WHERE label NOT IN (FROM h) GROUP BY label)
      FROM h UNION ALL SELECT label FROM s WHERE shared >= 3 AND shared / least(n, (SELECT count(*) FROM oh)) >= 0.25"""),
    "priors_functional": (priors_functional, BOXES + """, o AS (SELECT local, count(DISTINCT label) AS labels FROM own GROUP BY local HAVING labels >= 3), t AS (SELECT local, unnest(list_filter(regexp_split_to_array(local, '[^a-z]+'), lambda x: x <> '')) AS token FROM o)
      SELECT local, labels FROM o WHERE local IN (SELECT local FROM t WHERE token NOT IN (SELECT f FROM p UNION SELECT l FROM p) AND NOT (length(token) > 2 AND substr(token, 2) IN (SELECT f FROM p UNION SELECT l FROM p)))"""),
    "priors_qualifiers": (priors_qualifiers, BOXES + """, t AS (SELECT f AS before, l AS token FROM p UNION ALL SELECT l, list_extract(['ae', 'lead', 'müller'], CAST(doc_id % 3 AS INT) + 1) FROM p WHERE doc_id % 2 = 0), q AS (SELECT token, count(DISTINCT before) AS partners FROM t GROUP BY token HAVING partners >= 8),
      b AS (SELECT token, count(*) AS boxes FROM (SELECT unnest(regexp_split_to_array(local, '[^a-z]+')) AS token FROM m UNION ALL SELECT unnest(regexp_split_to_array('mueller.' || local, '[^a-z]+')) FROM m) GROUP BY token)
      SELECT q.token, partners FROM q LEFT JOIN b ON b.token = CASE q.token WHEN 'müller' THEN 'mueller' ELSE q.token END WHERE 4 * coalesce(boxes, 0) < partners"""),
}
