"""Column profile, analysis summary and the reports built on them.

Four passes over the table whatever its width: one aggregate per column (missing cells and moments), one
count per (column, value), which yields distinct counts and modes together, one over the text cells, and the
first rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T, Window

from millrace.functions import values as V

# Sizes and thresholds of the profile.
SAMPLE_ROWS, PREVIEW_ROWS = 5, 20
DATETIME_SHARE = 0.8
FILL_SHARE, IDENTIFIER_SHARE = 0.2, 0.9
AVAILABLE_EDITS = (
    "rename_columns", "cast_types", "fill_missing_values", "drop_columns", "filter_rows", "sort_by", "limit_rows",
)
METRIC_RULES = (
    ("missing|null", "%", "0-100%", "lower_is_better"),
    ("row|column|feature", "count", ">= 0", "context_only"),
    ("cardinality|unique", "count", ">= 0", "context_only"),
    ("", "raw", "context dependent", "context_only"),
)


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _number_sql(f: T.StructField) -> str:
    name = _quoted(f.name)
    if isinstance(f.dataType, T.FractionalType) and not isinstance(f.dataType, T.DecimalType):
        return f"if(isnan({name}) OR abs({name}) = double('inf'), NULL, double({name}))"
    return f"CAST({name} AS DOUBLE)" if V.is_numeric(f.dataType) else "CAST(NULL AS DOUBLE)"


def _key_sql(f: T.StructField) -> str:
    """Cell as text: nested values as canonical JSON, -0.0 and 0.0 as one value."""
    name = _quoted(f.name)
    if isinstance(f.dataType, T.MapType):
        return f"to_json(map_from_entries(array_sort(map_entries({name}))))"
    if V.is_nested(f.dataType):
        return f"to_json({name})"
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return f"string(if(isnan({name}) OR abs({name}) = double('inf'), NULL, {name} + 0.0D))"
    return f"CAST({name} AS STRING)"


def value_kind(col: Column) -> Column:
    """Kind of a raw text value as a type-less file reader would see it."""
    text = F.trim(col)
    return (
        F.when(text.rlike(r"^[+-]?\d+$"), "int")
        .when(text.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"), "float")
        .when(F.lower(text).isin("true", "false"), "bool")
        .otherwise("str")
    )


def text_facts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, datetime_confidence, kinds, mixed_type) over all values of all text columns, in one pass."""
    cells = df.select(*[_c(c) for c in columns]).unpivot([], [_c(c) for c in columns], "column", "value").where(F.col("value").isNotNull())
    kind = value_kind(F.col("value"))
    found = cells.groupBy("column").agg(
        F.avg(V.as_timestamp(F.col("value"), T.StringType()).isNotNull().cast("double")).alias("share"), F.collect_set(kind).alias("kinds")
    )
    return found.select(
        "column", F.round("share", 4).alias("datetime_confidence"), F.array_join(F.array_sort("kinds"), ",").alias("kinds"), (F.size("kinds") > 1).alias("mixed_type")
    )


def _measured(df: DataFrame) -> DataFrame:
    """One row per column: rows, missing cells and moments.

    Cells become (column, number, present) rows, so the plan does not grow with the width of the
    table, and are combined per column before the shuffle.
    """
    cells = []
    for f in df.schema.fields:
        number = _number_sql(f)
        present = number if V.is_numeric(f.dataType) else _quoted(f.name)
        cells.append(f"named_struct('number', {number}, 'present', {present} IS NOT NULL) AS {_quoted(f.name)}")
    long = df.selectExpr(*cells).unpivot([], [_c(f.name) for f in df.schema.fields], "column", "cell")
    facts = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("cell.present")).alias("null_count"), F.avg("cell.number").alias("mean"),
        F.stddev_samp("cell.number").alias("std"), F.min("cell.number").alias("min"), F.max("cell.number").alias("max"),
    )
    kinds = [(i, f.name, f.dataType.simpleString(), "numeric" if V.is_numeric(f.dataType) else "datetime" if V.is_datetime(f.dataType) else "text")
             for i, f in enumerate(df.schema.fields)]
    named = df.sparkSession.createDataFrame(kinds, "position int, column string, dtype string, base string")
    counted = named.join(facts, "column", "left")
    return counted.withColumns({"rows": F.coalesce("rows", F.lit(0)), "null_count": F.coalesce("null_count", F.lit(0))})


def _distinct(df: DataFrame, exact: bool) -> DataFrame:
    """(column, unique_count, mode). Without ``exact`` distinct counts are estimated, modes left out."""
    fields = df.schema.fields
    text = df.selectExpr(*[f"{_key_sql(f)} AS {_quoted(f.name)}" for f in fields])
    cells = text.unpivot([], [_c(f.name) for f in fields], "column", "value").where(F.col("value").isNotNull())
    if not exact:
        return cells.groupBy("column").agg(F.approx_count_distinct("value").alias("unique_count"), F.lit(None).cast("string").alias("mode"))
    counts = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col("value").alias("v")))
    return counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"), best["v"].alias("mode"))


def column_explorer(df: DataFrame, order: Sequence[str], exact: bool = True) -> DataFrame:
    """One row per column: type, family, missing and distinct shares, samples, moments, mode.

    ``order`` names the columns that define which rows are shown as samples. ``rank`` is the display order:
    most missing first, then most distinct.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    out = _measured(df).join(_distinct(df, exact), "column", "left")
    if texts:
        out = out.join(text_facts(df, texts), "column", "left")
    else:
        out = out.withColumns({"datetime_confidence": F.lit(0.0), "kinds": F.lit(None).cast("string"), "mixed_type": F.lit(False)})
    first = df.orderBy(*order).limit(SAMPLE_ROWS)
    shown = first.selectExpr(*[f"{_key_sql(f)} AS {_quoted(f.name)}" for f in df.schema.fields], f"struct({', '.join(_quoted(c) for c in order)}) AS _k")
    samples = (
        shown.unpivot(["_k"], [_c(f.name) for f in df.schema.fields], "column", "value").groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("_k", "value")))["value"].alias("v"))
        .select("column", F.array_join("v", "|", "null").alias("sample_values"))
    )
    size = F.greatest(F.col("rows"), F.lit(1))
    bound = F.least(F.greatest(F.floor(size / 2), F.lit(20)), size)
    unique = F.coalesce("unique_count", F.lit(0))
    confidence = F.coalesce("datetime_confidence", F.lit(0.0))
    family = (
        F.when(F.col("base") != "text", F.col("base"))
        .when(confidence >= DATETIME_SHARE, "datetime_candidate")
        .otherwise("categorical")
    )
    ranked = Window.orderBy(F.desc("null_count"), F.desc("unique_count"), "position")  # one row per column
    return (
        out.join(samples, "column", "left")
        .withColumns({"unique_count": unique, "datetime_confidence": confidence, "family": family})
        .withColumns({
            "null_ratio": F.round(F.col("null_count") / size, 6),
            "unique_ratio": F.round(F.col("unique_count") / size, 6),
            "high_cardinality": F.col("unique_count") >= bound,
            "mixed_type": F.coalesce("mixed_type", F.lit(False)),
            "mode": F.when(F.col("base") != "numeric", F.col("mode")),
            "rank": F.row_number().over(ranked),
        })
        .drop("base")
    )


def dataset_profile(explorer: DataFrame) -> DataFrame:
    """One row: column lists per family, the last column as target, the others as inputs."""
    def names(*families: str) -> Column:
        return F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(F.col("family").isin(*families), F.struct("rank", "column")))), lambda x: x["column"]), ","
        )

    ordered = F.array_sort(F.collect_list(F.struct("position", "column")))["column"]
    return explorer.agg(
        names("numeric").alias("numeric_columns"),
        names("categorical").alias("categorical_columns"),
        names("datetime", "datetime_candidate").alias("datetime_columns"),
        ordered.alias("o"),
    ).select(
        "numeric_columns", "categorical_columns", "datetime_columns",
        F.element_at("o", -1).alias("recommended_target"),
        F.array_join(F.slice("o", F.lit(1), F.size("o") - 1), ",").alias("recommended_inputs"),
    )


def feature_extraction_summary(explorer: DataFrame) -> DataFrame:
    return explorer.agg(
        F.max_by("column", "position").alias("target_candidate"),
        (F.count(F.lit(1)) - 1).alias("feature_candidates"),
        F.count_if(F.col("family") == "numeric").alias("numeric_feature_count"),
        F.count_if(F.col("family") == "categorical").alias("categorical_feature_count"),
        F.count_if(F.col("family").isin("datetime", "datetime_candidate")).alias("datetime_feature_count"),
    )


def _first(rows: DataFrame, limit: int | None) -> DataFrame:
    ordered = rows.orderBy("place")
    return ordered if limit is None else ordered.limit(limit)


def analysis_warnings(explorer: DataFrame, limit: int | None = None) -> DataFrame:
    """(place, warning) in column order."""
    rows = F.array_compact(
        F.array(
            F.when(F.col("mixed_type"), F.struct((F.col("position") * 2).alias("place"), F.format_string("Column '%s' mixes several value types.", "column").alias("warning"))),
            F.when(F.col("high_cardinality"), F.struct((F.col("position") * 2 + 1).alias("place"), F.format_string("Column '%s' has high cardinality.", "column").alias("warning"))),
        )
    )
    return _first(explorer.select(F.explode(rows).alias("w")).select("w.*"), limit)


def transform_suggestions(explorer: DataFrame, columns: int | None = None, limit: int | None = None) -> DataFrame:
    """(place, type, column, value): fill, cast or drop proposals, for the first ``columns`` shown if given."""
    def entry(offset: int, kind: str, value: str | None = None) -> Column:
        return F.struct(
            (F.col("rank") * 3 + offset).alias("place"), F.lit(kind).alias("type"), F.col("column"),
            F.lit(value).cast("string").alias("value"),
        )

    rows = F.array_compact(
        F.array(
            F.when(F.col("null_ratio") >= FILL_SHARE, entry(0, "fill")),
            F.when(F.col("family") == "datetime_candidate", entry(1, "cast", "datetime")),
            F.when((F.col("family") == "categorical") & (F.col("unique_ratio") >= IDENTIFIER_SHARE), entry(2, "drop")),
        )
    )
    shown = explorer if columns is None else explorer.where(F.col("rank") <= columns)
    return _first(shown.select(F.explode(rows).alias("s")).select("s.*"), limit)


def metric_cards(metrics: DataFrame) -> DataFrame:
    """(key, value) rows with label, unit, expected range and direction from the name rules."""
    name = F.lower(F.trim("key"))

    def pick(index: int) -> Column:
        *ruled, (_, *last) = METRIC_RULES
        col = F.lit(last[index])
        for rule in reversed(ruled):
            col = F.when(name.rlike(rule[0]), F.lit(rule[1 + index])).otherwise(col)
        return col

    return metrics.select(
        "key", F.initcap(F.regexp_replace("key", "_", " ")).alias("label"), "value",
        pick(0).alias("unit"), pick(1).alias("expected_range"), pick(2).alias("direction"),
    )


def dataset_metrics(explorer: DataFrame) -> DataFrame:
    """(key, value): the headline numbers of a profile."""
    row = explorer.agg(
        F.max("rows").alias("row_count"), F.count(F.lit(1)).alias("column_count"),
        F.round(F.sum("null_count") / F.greatest(F.max("rows") * F.count(F.lit(1)), F.lit(1)), 6).alias("missing_ratio"),
        F.count_if(F.col("family") == "numeric").alias("numeric_columns"),
        F.count_if(F.col("family") == "categorical").alias("categorical_columns"),
        F.count_if(F.col("family") == "datetime_candidate").alias("datetime_candidates"),
    )
    return row.select(*[F.col(c).cast("double").alias(c) for c in row.columns]).unpivot([], row.columns, "key", "value")


def dataset_charts(explorer: DataFrame, bars: int | None = None) -> DataFrame:
    """(chart, place, label, value): type balance, columns by missing cells, numeric means; ``bars`` rows of each if given."""
    shown = F.lit(True) if bars is None else F.col("place") <= bars
    kind = F.when(F.col("family") == "numeric", 1).when(F.col("family") == "categorical", 2).otherwise(3)
    counts = explorer.agg(*[F.count_if(kind == i).cast("double").alias(n) for i, n in enumerate(("Numeric", "Categorical", "Datetime"), 1)])
    types = counts.unpivot([], counts.columns, "label", "value").select(
        F.lit("Column Types").alias("chart"),
        F.when(F.col("label") == "Numeric", 1).when(F.col("label") == "Categorical", 2).otherwise(3).alias("place"), "label", "value",
    )
    by_missing = Window.orderBy(F.desc("null_count"), "position")
    missing = explorer.select(
        F.lit("Missing Values by Column").alias("chart"), F.row_number().over(by_missing).alias("place"),
        F.col("column").alias("label"), F.col("null_count").cast("double").alias("value"),
    ).where(shown)
    means = explorer.where("family = 'numeric'").select(
        F.lit("Numeric Mean Snapshot").alias("chart"), F.row_number().over(Window.orderBy("position")).alias("place"),
        F.col("column").alias("label"), F.col("mean").alias("value"),
    ).where(shown & F.col("value").isNotNull())
    return types.unionByName(missing).unionByName(means)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """(rows, fingerprint): does not depend on row order, partitioning or file layout."""
    cells = [F.coalesce(F.expr(_key_sql(f)), F.lit("\\N")) for f in df.schema.fields]
    digits = F.conv(F.substring(F.md5(F.concat_ws("\u0001", *cells)), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(digits), F.lit(0)).cast("string").alias("fingerprint"))


def feature_statistics(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per feature of a what-if request: numeric range and moments, else mode and distinct count."""
    return column_explorer(df, order).select(
        "column", F.when(F.col("family") == "numeric", "numeric").otherwise("categorical").alias("family"),
        "min", "max", "mean", "std", "mode", F.when(F.col("family") != "numeric", F.col("unique_count")).alias("unique_values"),
    )


def preview_rows(df: DataFrame, order: Sequence[str], limit: int = PREVIEW_ROWS) -> DataFrame:
    """(place, row): the first rows in ``order`` as JSON texts, missing values included."""
    first = df.orderBy(*order).limit(limit).agg(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("k"), F.struct(*df.columns).alias("r")))).alias("v"))
    return first.select(F.posexplode("v").alias("place", "e")).select(
        (F.col("place") + 1).alias("place"), F.to_json("e.r", {"ignoreNullFields": "false"}).alias("row"))


def extraction_manifest(df: DataFrame, explorer: DataFrame, dataset_id: int, name: str, order: Sequence[str]) -> DataFrame:
    """One row describing an extracted table: shape, columns, the first rows in ``order`` and the edits it allows."""
    words = "_".join("".join(ch.lower() if ch.isalnum() else " " for ch in name).split()) or "artifact"
    facts = ("column", "dtype", "family", "null_count", "null_ratio", "unique_count", "unique_ratio", "high_cardinality", "mixed_type", "sample_values")
    preview = preview_rows(df, order).agg(F.array_sort(F.collect_list(F.struct("place", "row")))["row"].alias("v"))
    return explorer.agg(
        F.lit(dataset_id).alias("dataset_id"), F.lit(name).alias("dataset_name"),
        F.lit(f"dataset_{dataset_id}_{words}").alias("table_name"),
        F.max("rows").alias("row_count"), F.count(F.lit(1)).alias("column_count"),
        F.sum("null_count").alias("missing_values"), F.lit(",".join(AVAILABLE_EDITS)).alias("available_edits"),
        F.transform(F.array_sort(F.collect_list(F.struct("position", F.struct(*facts).alias("f")))), lambda c: c["f"]).alias("columns"),
    ).withColumn("preview_rows", preview.scalar())
