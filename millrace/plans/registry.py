"""Named queries over the test tables and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.session import table_path
from millrace.sources.readers import spread_rows

# Texts and events in one small file each: the work per row is worth a shuffle.
TEXT_TABLES = ("documents", "events", "conversations", "pages")

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``covers`` lists the inventory rows it exercises."""

    def keep(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = function
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return spread_rows(df) if name in TEXT_TABLES else df
