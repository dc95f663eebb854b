"""Registry of named queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None, views: tuple[str, ...] = ()) -> None:
    """views: adapter views that the SQL names; they are put before it as common table expressions."""
    from dealspark.plans.adapters import VIEWS

    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = ("with " + ", ".join(f"{v} as ({VIEWS[v]})" for v in views) + " " if views else "") + sql.strip()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
