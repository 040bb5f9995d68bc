from loomstead.api import Api
from loomstead.plans import claims, library
from loomstead.sources.store import settled, write_generation

SF = "/root/testdata/sf0.001"


def test_every_answer(spark, tmp_path):
    tables = {name: settled(df) for name, df in claims._graph(spark, SF).items()}
    named = library.aliases(spark, SF)
    graph = library.graph(spark, SF)
    entities = named.selectExpr("eid", "name AS canonical_name", "1.0D AS confidence", "occurrences").dropDuplicates(["eid"])
    keyed = named.selectExpr("concat(kind, ':', lower(surface)) AS key", "surface", "kind", "occurrences", "eid").dropDuplicates(["key"])
    tables |= {"entities": entities, "aliases": keyed.drop("eid"), "resolves_to": keyed.selectExpr("key", "eid", "1.0D AS score", "'SOLE_SURFACE' AS signals"), "denotes": library.L.surface_graph(named)["denotes"]}
    tables |= {k: settled(graph[k].withColumn("doc_id", graph[k]["doc_id"].cast("string"))) for k in ("mentioned_in", "spoke_in", "sent")}
    api = Api(tables, "g1")
    top = api.disagreements(3).collect()
    assert len(top) == 3 and top[0].weight >= top[1].weight
    sides = api.disagreement(top[0].key).collect()
    assert len(sides) == top[0].claims and sides[0].side == 1
    assert api.contradicted_by(sides[0].claim_id).count() > 0
    edge = tables["supersedes"].first()
    assert api.history(edge.src).first().length >= 1
    eid = spark.createDataFrame([(7,)], "eid long")
    assert api.claims_about(eid, 5).count() == 5 and api.entity(eid).count() >= 2
    assert [r.eid for r in api.who(spark.createDataFrame([("Buyer 000000007",)], "text string")).collect()] == [7]
    assert {r.what for r in api.stats().collect()} == set(tables) and api.ontology(4).count() == 4 and api.claim_stats().count() > 5
    assert api.blast(sides[0].claim_id).count() >= 0 and Api(tables, "other").disagreements().count() == 0


def test_a_generation_is_replaced_and_others_stay(spark, tmp_path):
    rows = spark.range(3)
    for gen, n in (("a", 3), ("b", 2), ("a", 1)):
        write_generation(rows.limit(n), str(tmp_path / "t"), gen)
    assert {r.gen: r["count"] for r in spark.read.parquet(str(tmp_path / "t")).groupBy("gen").count().collect()} == {"a": 1, "b": 2}
