from loomstead.llm import registry


def test_every_operator_has_one_query():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 11)] and "pipeline" in names
    assert set(registry.oracle_sql()) <= set(names)
