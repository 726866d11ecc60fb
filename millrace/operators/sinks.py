"""Writers: feature views, exports, manifests, vector index and upserts."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, functions as F

from millrace.operators.profile import table_fingerprint
from millrace.operators.registry import upsert_pairs
from millrace.operators.retrieval import index_status
from millrace.operators.versions import history, read_version, replace_version


def materialise_view(
    df: DataFrame, name: str, root: str, mode: str = "structured", source: str = "", secondary: str | None = None,
    sql_hash: str | None = None, description: str | None = None, table: str | None = None,
) -> DataFrame:
    """Replace a named feature view and record it as a dataset; returns the dataset row.

    The view is a version below ``root`` (see ``versions``): readers see the old one until the new one is whole. With
    ``table`` a catalog view of that name is moved to the new version in one statement.
    """
    spark = df.sparkSession
    text = lambda v: F.lit(v).cast("string")
    line = replace_version(df, root, {
        "name": text(name), "mode": text(mode), "source": text(source), "secondary": text(secondary), "sql_hash": text(sql_hash), "table_name": text(table),
    })
    if table:
        folder = line.select("folder").first()["folder"]
        spark.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM parquet.`{root}/{folder}`")
    return dataset_row(line, root, description)


def dataset_row(line: DataFrame, root: str, description: str | None = None) -> DataFrame:
    """Registry row of a dataset from a line of its history."""
    entry = F.struct(
        F.lit("feature_materialize").alias("operation"), F.col("recorded_at").alias("when"), F.col("source").alias("source_dataset_id"),
        F.col("secondary").alias("secondary_dataset_id"), "mode", "table_name", F.col("table_name").isNotNull().alias("materialized"), "sql_hash",
    )
    told = F.lit(description) if description else F.concat(F.lit("Feature workspace materialization derived from dataset #"), "source", F.lit("."))
    return line.select(
        "name", told.alias("description"), F.lit("dataset").alias("object_type"), F.round(F.col("bytes") / (1 << 20), 4).alias("size"),
        F.concat(F.lit(f"{root}/"), "folder").alias("path"), F.col("recorded_at").alias("date"), "version", F.array(entry).alias("history"),
        F.lit("dataset").alias("dataset_type"), F.array("rows", F.col("columns").cast("bigint")).alias("shape"), (F.col("columns") > 0).alias("has_features"),
        F.col("features").alias("features_list"), F.concat(F.lit("table:"), F.coalesce("table_name", "name")).alias("connection_string"),
    )


def export_csv(df: DataFrame, path: str) -> None:
    """UTF-8 with a header; many part files, quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)


def export_jsonl(df: DataFrame, path: str, keep_nulls: bool = True) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", not keep_nulls).json(path)


def write_manifest(df: DataFrame, path: str, facts: Mapping[str, Any], sources: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """One JSON row: facts of the caller with shape, features, fingerprint and record counts of the table.

    ``kind`` names a column of few values, counted value by value. ``sources`` (path, source_type, ...) may be of any
    length: it is written as a table of its own, ``path``-sources, and counted.
    """
    features = F.array(*[F.lit(c) for c in df.columns])
    row = table_fingerprint(df).select(
        *[F.lit(v).alias(k) for k, v in facts.items()], F.current_timestamp().alias("recorded_at"), F.col("rows").alias("record_count"),
        F.lit(len(df.columns)).alias("feature_count"), features.alias("features_list"),
        F.array("rows", F.lit(len(df.columns)).cast("bigint")).alias("shape"), F.sha2("fingerprint", 256).alias("dataset_hash"),
        F.lit("Keys containing api_key, authorization, bearer, password, secret, or token are redacted.").alias("redaction_policy"),
    )
    if kind:
        counts = df.groupBy(F.coalesce(F.col(kind).cast("string"), F.lit("unknown")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        row = row.withColumn("record_counts", counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias("m")).scalar())
    if sources is not None:
        sources.write.mode("overwrite").json(f"{path}-sources")
        listed = df.sparkSession.read.schema(sources.schema).json(f"{path}-sources")
        row = row.withColumns({"source_files": F.lit(f"{path}-sources"), "source_file_count": listed.agg(F.count(F.lit(1)).alias("n")).scalar()})
    row.coalesce(1).write.mode("overwrite").json(path)
    return row


def write_index(index: DataFrame, path: str) -> DataFrame:
    """Vector index as Parquet; returns its status with the index hash."""
    index.write.mode("overwrite").parquet(path)
    written = index.sparkSession.read.parquet(path)
    digest = table_fingerprint(written.select("reference_id", "content_hash")).select(F.sha2("fingerprint", 256).alias("h")).scalar()
    return index_status(written).withColumn("index_hash", digest)


def upsert_to(root: str, incoming: DataFrame) -> DataFrame:
    """Merge incoming pairs into the current version below ``root`` and make the result the next one.

    Without a version the incoming pairs are the first. Returns the new current table.
    """
    spark = incoming.sparkSession
    if history(spark, root).isEmpty():
        stored = upsert_pairs(incoming.withColumn("history", F.array().cast("array<string>")).limit(0), incoming)
    else:
        stored = upsert_pairs(read_version(spark, root), incoming)
    replace_version(stored, root)
    return read_version(spark, root)
