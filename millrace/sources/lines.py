"""Lines of text files with their byte offsets.

A file is read in splits like any text table. Lines of a split keep their order, so the offset of a line is the bytes
of all earlier splits of its file plus those before it in its own split. No file is read as a whole by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def line_columns() -> list:
    """What has to be selected from a text source (read with ``lineSep`` as a line feed) for ``with_offsets``."""
    meta = {"_path": "file_path", "file": "file_name", "_block": "file_block_start"}
    return ["value", *[F.col(f"_metadata.{source}").alias(name) for name, source in meta.items()]]


def with_offsets(lines: DataFrame) -> DataFrame:
    """(value, offset, file) of lines selected by ``line_columns``; a carriage return before the line feed is no text."""
    sized = lines.withColumn("_at", F.monotonically_increasing_id()).withColumn("_size", F.octet_length("value").cast("bigint") + 1)
    inside = Window.partitionBy("_path", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = sized.groupBy("_path", "_block").agg(F.sum("_size").alias("_all"))
    starts = splits.select("_path", "_block", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_start"))
    placed = sized.withColumn("_in", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(starts, ["_path", "_block"])
    text = F.when(F.col("value").endswith("\r"), F.substring("value", F.lit(1), F.length("value") - 1)).otherwise(F.col("value"))
    return placed.select(text.alias("value"), (F.col("_start") + F.col("_in")).alias("offset"), "file")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, offset, file): all lines of text files with the byte at which each starts."""
    return with_offsets(spark.read.option("lineSep", "\n").text(path).select(*line_columns()))
