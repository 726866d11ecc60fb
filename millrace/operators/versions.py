"""Tables that are replaced as a whole.

A version is a new folder. One line in ``history``, written after the folder, makes it the current one, so a write that
fails half-way, or is repeated after a lost driver, leaves the version before it readable. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_LINE = "version bigint, folder string, rows bigint, bytes bigint, columns int, features array<string>, recorded_at timestamp"


def history(spark: SparkSession, root: str) -> DataFrame:
    """(version, folder, rows, bytes, columns, features, recorded_at, ...) of all whole versions; no rows if there is none."""
    try:
        return spark.read.option("mergeSchema", True).parquet(f"{root}/history")
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], _LINE)


def _newest(spark: SparkSession, root: str):
    return history(spark, root).select("version", "folder").orderBy(F.desc("version"), F.desc("recorded_at"), "folder").first()


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The current version, or a numbered one."""
    if version is None:
        found = _newest(spark, root)
    else:
        found = history(spark, root).where(F.col("version") == version).orderBy(F.desc("recorded_at"), "folder").select("folder").first()
    if found is None:
        raise ValueError(f"No such version below {root}")
    return spark.read.parquet(f"{root}/{found['folder']}")


def replace_version(df: DataFrame, root: str, facts: Mapping[str, Column] | None = None) -> DataFrame:
    """Write ``df`` as the next version; returns its line of the history.

    ``facts`` are more columns of that line. Rows and bytes are counted by file over what was written, so ``df`` is
    computed once, and ``df`` may read the current version.
    """
    spark = df.sparkSession
    before = _newest(spark, root)
    number, folder = (before["version"] if before else 0) + 1, f"data-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{root}/{folder}")
    written = spark.read.parquet(f"{root}/{folder}")
    files = written.groupBy("_metadata.file_path").agg(F.count(F.lit(1)).alias("n"), F.max("_metadata.file_size").alias("size"))
    features = F.array(*[F.lit(c) for c in written.columns]) if written.columns else F.array().cast("array<string>")
    line = files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).select(
        F.lit(number).cast("bigint").alias("version"), F.lit(folder).alias("folder"), "rows", "bytes", F.lit(len(written.columns)).alias("columns"),
        features.alias("features"), F.current_timestamp().alias("recorded_at"), *[c.alias(n) for n, c in (facts or {}).items()],
    )
    line.write.mode("append").parquet(f"{root}/history")
    return history(spark, root).where(F.col("folder") == folder)
