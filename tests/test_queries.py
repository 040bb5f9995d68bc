"""Every query with SQL is held against DuckDB over the same small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
LLM = ("op", "pipeline")


def rows(columns, values):
    return sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in values), columns


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith(LLM)])
def test_query_agrees_with_sql(spark, tables, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = rows(columns, [tuple(r) for r in df.select(columns).collect()])
    result = tables.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    at = [names.index(c) for c in columns]
    assert sorted(names) == columns
    assert rows(columns, [[r[i] for i in at] for r in result.fetchall()]) == got


def test_entry(spark):
    assert entry.entry(spark).count() == 40
