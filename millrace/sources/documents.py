"""Readers for JSON values shown as tables, run ledgers, activity logs and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from millrace.operators.corpus import load_jsonl

EVENT = "struct<status:string,stage:string,timestamp:string,message:string>"
RUN_DOCUMENT = (
    "run_id string, run_type string, status string, stage string, created_at string, updated_at string, started_at string, completed_at string, "
    "error string, context map<string,string>, parameters map<string,string>, metrics map<string,string>, artifacts map<string,string>, "
    f"result map<string,string>, queue map<string,string>, failure map<string,string>, events array<{EVENT}>, "
    f"progress struct<current_stage:string,latest_event:string,latest_timestamp:string,timeline:array<{EVENT}>>, "
    "terminal struct<cap:int,next_index:bigint,lines:array<struct<index:bigint,timestamp:string,stream:string,stage:string,message:string>>>"
)
ACTIVITY = "timestamp STRING, event_type STRING, message STRING, details MAP<STRING,STRING>"


def _is_kind(value: Column, *kinds: str) -> Column:
    return F.schema_of_variant(value).rlike("^(" + "|".join(kinds) + ")")


def json_tables(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, shape, row, column, place, value): a JSON value as table cells in long form.

    Accepted are an object of ``columns`` and ``rows``, an array of objects and a flat object.
    Everything else gives one row with shape ``not_tabular``. Cells are compact text; a column
    that a record lacks has no cell.
    """
    doc = df.select(key, F.col(json).alias("_j"), F.try_parse_json(json).alias("_v"))
    text = F.trim("_j")
    as_objects = F.from_json(F.when(text.startswith("["), text), "array<map<string,string>>")
    raw_items = F.from_json(F.when(text.startswith("["), text), "array<string>")
    flat = F.from_json(F.when(text.startswith("{"), text), "map<string,string>")
    columns = F.from_json(F.get_json_object("_j", "$.columns"), "array<string>")
    rows = F.from_json(F.get_json_object("_j", "$.rows"), "array<array<string>>")
    valid = F.col("_v").isNotNull()
    objects = valid & text.startswith("[") & (F.size(raw_items) > 0) & F.forall(raw_items, lambda i: F.ltrim(i).startswith("{"))
    nested = F.exists(F.map_values(flat), lambda v: v.startswith("{") | v.startswith("["))
    shape = (
        F.when(valid & columns.isNotNull() & rows.isNotNull(), "columns_rows").when(objects, "array_of_objects")
        .when(valid & text.startswith("{") & (F.size(flat) > 0) & ~nested, "flat_object").otherwise("not_tabular")
    )
    staged = doc.select(key, shape.alias("shape"), columns.alias("_c"), rows.alias("_r"), as_objects.alias("_o"), flat.alias("_f"))

    def cell(row: Column, column: Column, value: Column) -> Column:
        return F.struct(row.cast("int").alias("row"), column.alias("column"), F.coalesce(value, F.lit("")).alias("value"))

    by_rows = F.flatten(F.transform("_r", lambda r, i: F.transform("_c", lambda c, j: cell(i, c, F.get(r, j)))))
    by_object = F.flatten(F.transform("_o", lambda o, i: F.transform(F.map_entries(o), lambda e: cell(i, e["key"], e["value"]))))
    pairs = F.flatten(F.transform(F.map_entries("_f"), lambda e, i: F.array(cell(i, F.lit("key"), e["key"]), cell(i, F.lit("value"), e["value"]))))
    cells = F.when(F.col("shape") == "columns_rows", by_rows).when(F.col("shape") == "array_of_objects", by_object).when(F.col("shape") == "flat_object", pairs)
    return staged.select(key, "shape", F.explode_outer(cells).alias("c")).select(key, "shape", "c.row", "c.column", "c.value")


def _ledger_documents(spark: SparkSession, folder: str, lines: bool) -> DataFrame:
    schema = T._parse_datatype_string(RUN_DOCUMENT + ", _bad string")
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    return reader.option("multiLine", not lines).json(folder)


def read_run_ledger(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """One row per run document, from one document a file or, with ``lines``, one a line; unreadable ones are skipped."""
    return _ledger_documents(spark, folder, lines).where("_bad IS NULL AND run_id IS NOT NULL").drop("_bad")


def ledger_counts(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """(documents, runs, rejected): what ``read_run_ledger`` keeps and what it skips."""
    kept = F.col("_bad").isNull() & F.col("run_id").isNotNull()
    return _ledger_documents(spark, folder, lines).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(kept).alias("runs"), F.count_if(~kept).alias("rejected")
    )


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    """Activity lines; lines that are no JSON object are skipped."""
    return load_jsonl(spark.read.text(path), ACTIVITY).where("NOT rejected").drop("rejected")


def latest_activity(activity: DataFrame, limit: int) -> DataFrame:
    return activity.orderBy(F.desc("timestamp"), F.desc("message")).limit(max(1, limit))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, offset, value): lines with their file name and an increasing offset within it."""
    lines = spark.read.text(path)
    source = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return lines.select(source.alias("source"), F.monotonically_increasing_id().alias("offset"), "value")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Harvested catalog documents, one JSON text per row."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("doc"))
