"""Collects (query, SQL) pairs of all families."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (tables) -> DataFrame, tables being a reader by name."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return add


class Tables:
    """t.orders and so on: the tables of a folder, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def load() -> None:
    """Import the families, which registers their queries."""
    from tessera.plans import aggregates, documents, graphs, records, scalars, searches, services, times  # noqa: F401
