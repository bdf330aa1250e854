"""Queries by name, with the inventory ids they cover and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


def query(ids: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; ids: inventory ids it covers, blank-separated."""

    def register(f: Query) -> Query:
        name = f.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name], COVERS[name] = f, ids.split()
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
