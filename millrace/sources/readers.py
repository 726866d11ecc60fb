"""Readers for delimited text, JSON and Parquet with one entry point by file extension."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from millrace.functions.values import as_double
from millrace.operators.profile import text_facts

# ---------------------------------------------------------------------------
# Formats, delimiters, and the words read as missing cells.
FORMATS = {
    ".csv": "CSV", ".tsv": "TSV", ".txt": "Delimited Text", ".json": "JSON", ".jsonl": "JSON Lines", ".parquet": "Parquet",
}
DELIMITERS = (",", "\t", ";", "|")
SNIFF_LINES, SNIFF_CHARACTERS = 10, 4096
WIDE_TABLE = 150
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)
CP1252_GAPS = ("81", "8D", "8F", "90", "9D")
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Loaded:
    frame: DataFrame
    loader: str
    delimiter: str | None = None
    encoding: str | None = None


def spread_rows(df: DataFrame) -> DataFrame:
    """Spread a table that comes in fewer pieces than there are task slots, before costly row work.

    A large table already has more pieces and is returned as it is, without a shuffle.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def capability_matrix(spark: SparkSession) -> DataFrame:
    uses = ("register", "inspect", "train", "predict", "simulate", "monitor")
    return spark.createDataFrame([(k, v, *[True] * len(uses)) for k, v in FORMATS.items()], ["extension", "label", *uses])


def extension_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def sniff_delimiter(sample: str, extension: str = ".csv") -> str:
    """Delimiter of a few sample lines; tab for ``.tsv``, comma without evidence."""
    if extension == ".tsv":
        return "\t"
    text = "\n".join(line for line in sample.splitlines()[:SNIFF_LINES] if line.strip())[:SNIFF_CHARACTERS]
    if not text:
        return ","
    try:
        return csv.Sniffer().sniff(text, delimiters="".join(DELIMITERS)).delimiter
    except csv.Error:
        return max(DELIMITERS, key=text.count)


def detect_encoding(spark: SparkSession, path: str) -> str:
    """utf-8, cp1252 or latin-1, decided over all lines without moving them.

    A byte order mark is removed by Spark's line reader, so utf-8 covers files with and without.
    """
    raw = spark.read.text(path)
    gaps = "|".join(CP1252_GAPS)
    facts = raw.agg(
        F.coalesce(F.bool_and(F.is_valid_utf8("value")), F.lit(True)).alias("utf8"),
        F.coalesce(F.bool_or(F.hex(F.col("value").cast("binary")).rlike(f"^(?:..)*(?:{gaps})")), F.lit(False)).alias("gap"),
    ).first()
    if facts["utf8"]:
        return "utf-8"
    return "latin-1" if facts["gap"] else "cp1252"


# Spark's CSV reader knows no cp1252; it is read as latin-1 and its own characters are put right after.
_CHARSETS = {"utf-8": "UTF-8", "cp1252": "ISO-8859-1", "latin-1": "ISO-8859-1"}
_CP1252_CODES = [b for b in range(0x80, 0xA0) if f"{b:02X}" not in CP1252_GAPS]
_CP1252_READ = "".join(chr(b) for b in _CP1252_CODES)
_CP1252_MEANT = bytes(_CP1252_CODES).decode("cp1252")


def _as_cp1252(raw: DataFrame) -> DataFrame:
    meant = str.maketrans(_CP1252_READ, _CP1252_MEANT)
    return raw.select(*[F.translate(F.col(f"`{c}`"), _CP1252_READ, _CP1252_MEANT).alias(c.translate(meant)) for c in raw.columns])


def infer_types(raw: DataFrame) -> DataFrame:
    """Typed columns of an all-text table: long, double or boolean where every present cell fits.

    Cells are turned into (column, cell) rows first, so the plan stays small however wide the
    table is; counts per column are combined before the shuffle. Dates stay text, as the profile
    expects.
    """
    cells = raw.unpivot([], [F.col(f"`{c}`") for c in raw.columns], "column", "cell")
    cell = F.trim("cell")
    present = F.when(~cell.isin(*MISSING_WORDS), cell)
    facts = cells.select("column", present.alias("cell")).where("cell IS NOT NULL").groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("cell").rlike(r"^[+-]?\d+$") & F.col("cell").try_cast("bigint").isNotNull()).alias("long"),
        F.count(as_double(F.col("cell"), T.StringType())).alias("double"), F.count_if(F.lower("cell").isin("true", "false")).alias("boolean"),
    )
    found = {r["column"]: next((k for k in ("long", "double", "boolean") if r[k] == r["n"]), "text") for r in facts.collect()}
    words = ", ".join("'" + w.replace("'", "''") + "'" for w in MISSING_WORDS)
    forms = {
        "long": "try_cast(trim({c}) AS BIGINT)", "boolean": "try_cast(trim({c}) AS BOOLEAN)", "text": "if(trim({c}) IN ({words}), NULL, {c})",
        "double": "nanvl(if(abs(try_cast(trim({c}) AS DOUBLE)) = double('inf'), NULL, try_cast(trim({c}) AS DOUBLE)), NULL)",
    }
    quoted = ["`" + c.replace("`", "``") + "`" for c in raw.columns]
    return raw.selectExpr(*[f"{forms[found.get(c, 'double')].format(c=q, words=words)} AS {q}" for c, q in zip(raw.columns, quoted)])


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None, multi_line: bool = False) -> Loaded:
    """Delimited text with a header. Delimiter and encoding are found if not given.

    Quoted line breaks need ``multi_line``, which keeps a file in one task.
    """
    code = encoding or detect_encoding(spark, path)
    if delimiter is None:
        head = spark.read.text(path).limit(SNIFF_LINES).collect()
        delimiter = sniff_delimiter("\n".join(r[0] for r in head), extension_of(path))
    raw = (
        spark.read.option("header", True).option("sep", delimiter).option("encoding", _CHARSETS.get(code, code))
        .option("quote", '"').option("escape", '"').option("multiLine", multi_line).csv(path)
    )
    if code == "cp1252":
        raw = _as_cp1252(raw)
    first = raw.columns[0] if raw.columns else ""
    clean = raw.withColumnRenamed(first, first.lstrip("﻿")) if first.startswith("﻿") else raw
    return Loaded(infer_types(clean), "csv", delimiter, code)


def flatten_structs(df: DataFrame) -> DataFrame:
    """Nested objects become dotted columns; arrays stay."""
    def leaves(schema: T.StructType, path: tuple[str, ...] = ()) -> list[Column]:
        out: list[Column] = []
        for f in schema.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(".".join(here)))
        return out

    return df.select(*leaves(df.schema))


def read_json_document(spark: SparkSession, path: str) -> Loaded:
    """A list of records, an object of columns (if any value is a list) or a single object."""
    data = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).first()
    is_list = head is not None and head[0].lstrip("﻿ \t").startswith("[")
    lists = [f.name for f in data.schema.fields if isinstance(f.dataType, T.ArrayType)]
    if not is_list and lists:
        zipped = data.select(*[c for c in data.columns if c not in lists], F.explode(F.arrays_zip(*[F.col(f"`{c}`") for c in lists])).alias("_z"))
        data = zipped.select(*[F.col(f"_z.`{c}`").alias(c) if c in lists else F.col(f"`{c}`") for c in data.columns])
        return Loaded(data, "json")
    return Loaded(flatten_structs(data), "json")


def read_json_lines(spark: SparkSession, path: str) -> Loaded:
    """One object per line; blank lines are skipped, anything else is an error."""
    return Loaded(flatten_structs(spark.read.option("mode", "FAILFAST").json(path)), "jsonl")


def read_parquet(spark: SparkSession, path: str) -> Loaded:
    return Loaded(spark.read.parquet(path), "parquet")


def load(spark: SparkSession, path: str, extension: str | None = None) -> Loaded:
    """Read by extension; unknown formats are refused with the list of supported ones."""
    kind = extension or extension_of(path)
    readers = {".json": read_json_document, ".jsonl": read_json_lines, ".parquet": read_parquet}
    if kind in (".csv", ".tsv", ".txt"):
        return read_delimited(spark, path, "\t" if kind == ".tsv" else None)
    if kind in readers:
        return readers[kind](spark, path)
    raise ValueError(f"Unsupported dataset format '{kind}'. Supported: {', '.join(FORMATS)}")


def load_registered(spark: SparkSession, path: str, dataset_type: str | None = None, connection: str | None = None) -> Loaded:
    """Dataset of a registry record. A corpus record names the one table written for it."""
    if dataset_type == "assistant_training_dataset":
        return read_parquet(spark, connection or path)
    return load(spark, path)


def parser_report(loaded: Loaded, order: Sequence[str] = ()) -> DataFrame:
    """One row: shape, loader, delimiter, encoding and warnings."""
    df = loaded.frame
    wide = f"Wide dataset with {len(df.columns)} columns." if len(df.columns) > WIDE_TABLE else None
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    report = df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("columns"), F.lit(loaded.loader).alias("loader"),
        F.lit(loaded.delimiter).cast("string").alias("delimiter"), F.lit(loaded.encoding).cast("string").alias("encoding"), F.lit(wide).cast("string").alias("wide"),
    )
    if not texts or not order:
        return report.withColumn("warnings", F.coalesce("wide", F.lit(""))).drop("wide")
    mixed = text_facts(df, texts).where("mixed_type").agg(F.array_join(F.array_sort(F.collect_list("column")), ",").alias("m"))
    mixed_note = F.concat(F.lit("Mixed types: "), F.nullif(mixed.scalar(), F.lit("")))
    return report.withColumn("warnings", F.concat_ws("; ", "wide", mixed_note)).drop("wide")


def is_markup(col: Column) -> Column:
    """HTML or XML in the first 512 characters, which is no table."""
    return F.lower(F.ltrim(F.substring(col, 1, 512))).rlike(r"^(<!doctype html|<html|<\?xml)")
