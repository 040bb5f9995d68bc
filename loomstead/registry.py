"""The queries over the library's own operators and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import asking, claims, corpus, files, library, orders_graph, people

PARTS = (claims, orders_graph, corpus, people, asking, library, files)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What do the documents disagree about most?"""
    return claims.top_disagreements(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for part in PARTS for name, (query, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, (_, sql) in part.QUERIES.items() if sql}
