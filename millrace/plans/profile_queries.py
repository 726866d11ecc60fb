"""Profiling queries. The SQL side is put together column by column."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import profile as P
from millrace.plans.registry import query, table

# One nullable view of events serves the whole family: (column, type, family, SQL expression).
_COLUMNS = (
    ("event_id", "bigint", "numeric", "event_id"),
    ("user_id", "bigint", "numeric", "nullif(user_id, 7)"),
    ("event_type", "string", "categorical", "nullif(event_type, 'error')"),
    ("value", "double", "numeric", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END"),
    ("seen", "string", "datetime_candidate", "CASE WHEN event_id % 10 = 1 THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d') END"),
    ("ts", "timestamp_ntz", "datetime", "ts"),
    ("big", "boolean", "numeric", "value > 20"),
)
_VIEW = "v AS (SELECT " + ", ".join(f"{e} AS {n}" for n, _, _, e in _COLUMNS) + " FROM events)"


def _view(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.expr("nullif(user_id, 7)").alias("user_id"),
        F.expr("nullif(event_type, 'error')").alias("event_type"),
        F.expr("CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END").alias("value"),
        F.expr("CASE WHEN event_id % 10 = 1 THEN 'n/a' ELSE date_format(ts, 'yyyy-MM-dd') END").alias("seen"),
        "ts",
        F.expr("value > 20").alias("big"),
    )


def _explore(spark, sf_dir):
    return P.column_explorer(_view(spark, sf_dir), ["event_id"])


def _column_sql(place: int, name: str, kind: str, family: str) -> str:
    number = f"CAST({name} AS DOUBLE)" if family == "numeric" else "CAST(NULL AS DOUBLE)"
    if family in ("categorical", "datetime_candidate"):
        confidence = (
            f"(SELECT round(avg(CASE WHEN try_cast(x AS TIMESTAMP) IS NULL THEN 0.0 ELSE 1.0 END), 4) FROM "
            f"(SELECT {name} AS x FROM v WHERE {name} IS NOT NULL))"
        )
    else:
        confidence = "CAST(0 AS DOUBLE)"
    mode = (
        f"(SELECT CAST({name} AS VARCHAR) FROM v WHERE {name} IS NOT NULL GROUP BY {name} ORDER BY count(*) DESC, {name} LIMIT 1)"
        if family != "numeric" else "CAST(NULL AS VARCHAR)"
    )
    return (
        f"SELECT {place} AS position, '{name}' AS \"column\", '{kind}' AS dtype, '{family}' AS family, count(*) AS rows, "
        f"count(*) - count({name}) AS null_count, count(DISTINCT {name}) AS unique_count, "
        f"{confidence} AS datetime_confidence, avg({number}) AS mean, stddev_samp({number}) AS std, "
        f"min({number}) AS min, max({number}) AS max, {mode} AS mode FROM v"
    )


_RAW = " UNION ALL ".join(_column_sql(i, n, k, f) for i, (n, k, f, _) in enumerate(_COLUMNS))
# Everything a report needs, with the derived shares and the display order.
_EXPLORER = f"""{_VIEW}, raw AS ({_RAW}), x AS (SELECT *,
    round(null_count / rows, 6) AS null_ratio, round(unique_count / rows, 6) AS unique_ratio,
    unique_count >= least(greatest(rows // 2, 20), rows) AS high_cardinality,
    row_number() OVER (ORDER BY null_count DESC, unique_count DESC, position) AS rank FROM raw)"""


@query(
    "profile_column_explorer",
    "PROF-1 PROF-2 PROF-3 PROF-5",
    f"""WITH {_EXPLORER} SELECT CAST(rank AS INTEGER) AS rank, "column", dtype, family, null_count, null_ratio,
        unique_count, unique_ratio, high_cardinality, datetime_confidence FROM x""",
)
def profile_column_explorer(spark, sf_dir):
    return _explore(spark, sf_dir).select(
        "rank", "column", "dtype", "family", "null_count", "null_ratio", "unique_count", "unique_ratio",
        "high_cardinality", "datetime_confidence",
    )


@query(
    "profile_sample_values",
    "PROF-1",
    f"""WITH {_VIEW}, h AS (SELECT * FROM v ORDER BY event_id LIMIT 5)
    """ + " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", string_agg(coalesce(CAST({n} AS VARCHAR), 'null'), '|' ORDER BY event_id) AS sample_values FROM h"
        for n, _, _, _ in _COLUMNS if n != "ts"
    ),
)
def profile_sample_values(spark, sf_dir):
    return _explore(spark, sf_dir).select("column", "sample_values").where("column <> 'ts'")


@query(
    "profile_analysis_summary",
    "PROF-8",
    f"""WITH {_EXPLORER} SELECT "column", family, null_count, unique_count, round(mean, 6) AS mean, round(std, 6) AS std,
        min, max, CASE WHEN "column" = 'ts' THEN NULL ELSE mode END AS mode FROM x""",
)
def profile_analysis_summary(spark, sf_dir):
    return _explore(spark, sf_dir).select(
        "column", "family", "null_count", "unique_count", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"),
        "min", "max", F.when(F.col("column") != "ts", F.col("mode")).alias("mode"),
    )


@query(
    "profile_mixed_types",
    "PROF-4",
    """
    WITH v AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN 'true'
                 WHEN 2 THEN '1.5' ELSE event_type END AS raw_mix, event_type AS raw_plain FROM events),
    h AS (SELECT 'raw_mix' AS "column", raw_mix AS value FROM (SELECT * FROM v WHERE raw_mix IS NOT NULL)
          UNION ALL SELECT 'raw_plain', raw_plain FROM (SELECT * FROM v WHERE raw_plain IS NOT NULL)),
    k AS (SELECT "column", CASE WHEN regexp_full_match(value, '[+-]?[0-9]+') THEN 'int'
          WHEN TRY_CAST(value AS DOUBLE) IS NOT NULL THEN 'float' WHEN value IN ('true', 'false') THEN 'bool' ELSE 'str' END AS kind FROM h)
    SELECT "column", string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(DISTINCT kind) > 1 AS mixed_type FROM k GROUP BY 1
    """,
)
def profile_mixed_types(spark, sf_dir):
    mix = "CASE event_id % 4 WHEN 0 THEN string(event_id) WHEN 1 THEN 'true' WHEN 2 THEN '1.5' ELSE event_type END"
    raw = table(spark, sf_dir, "events").select("event_id", F.expr(mix).alias("raw_mix"), F.col("event_type").alias("raw_plain"))
    return P.text_facts(raw, ["raw_mix", "raw_plain"]).select("column", "kinds", "mixed_type")


@query(
    "profile_nested_values",
    "PROF-6",
    """
    WITH t AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE '["' || o_orderstatus || '","' || o_orderpriority || '"]' END AS tags FROM orders)
    SELECT count(DISTINCT tags) AS unique_count, count(*) - count(tags) AS null_count,
      (SELECT tags FROM t WHERE tags IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, tags LIMIT 1) AS mode FROM t
    """,
)
def profile_nested_values(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.array("o_orderstatus", "o_orderpriority")).alias("tags")
    )
    return P.column_explorer(orders, ["o_orderkey"]).where("column = 'tags'").select("unique_count", "null_count", "mode")


@query(
    "profile_dataset_lists",
    "PROF-7",
    f"""WITH {_EXPLORER} SELECT
      string_agg("column", ',' ORDER BY rank) FILTER (WHERE family = 'numeric') AS numeric_columns,
      string_agg("column", ',' ORDER BY rank) FILTER (WHERE family = 'categorical') AS categorical_columns,
      string_agg("column", ',' ORDER BY rank) FILTER (WHERE family LIKE 'datetime%') AS datetime_columns,
      'big' AS recommended_target, 'event_id,user_id,event_type,value,seen,ts' AS recommended_inputs FROM x""",
)
def profile_dataset_lists(spark, sf_dir):
    return P.dataset_profile(_explore(spark, sf_dir))


@query(
    "profile_warnings",
    "PROF-9",
    f"""WITH {_EXPLORER} SELECT CAST(position * 2 + 1 AS INTEGER) AS place,
        'Column ''' || "column" || ''' has high cardinality.' AS warning FROM x WHERE high_cardinality""",
)
def profile_warnings(spark, sf_dir):
    return P.analysis_warnings(_explore(spark, sf_dir))


@query(
    "profile_extraction_summary",
    "PROF-10",
    f"""WITH {_EXPLORER} SELECT 'big' AS target_candidate, count(*) - 1 AS feature_candidates,
        count(*) FILTER (WHERE family = 'numeric') AS numeric_feature_count,
        count(*) FILTER (WHERE family = 'categorical') AS categorical_feature_count,
        count(*) FILTER (WHERE family LIKE 'datetime%') AS datetime_feature_count FROM x""",
)
def profile_extraction_summary(spark, sf_dir):
    return P.feature_extraction_summary(_explore(spark, sf_dir))


@query(
    "profile_suggestions",
    "PROF-11",
    f"""WITH {_EXPLORER} SELECT * FROM (
        SELECT CAST(rank * 3 AS INTEGER) AS place, 'fill' AS type, "column", CAST(NULL AS VARCHAR) AS value FROM x WHERE null_ratio >= 0.2
        UNION ALL SELECT CAST(rank * 3 + 1 AS INTEGER), 'cast', "column", 'datetime' FROM x WHERE family = 'datetime_candidate'
        UNION ALL SELECT CAST(rank * 3 + 2 AS INTEGER), 'drop', "column", NULL FROM x WHERE family = 'categorical' AND unique_ratio >= 0.9)""",
)
def profile_suggestions(spark, sf_dir):
    return P.transform_suggestions(_explore(spark, sf_dir))


@query(
    "profile_metric_cards",
    "PROF-12",
    f"""WITH {_EXPLORER}, m AS (
        SELECT 'row_count' AS key, CAST(max(rows) AS DOUBLE) AS value, 'count' AS unit FROM x
        UNION ALL SELECT 'column_count', count(*), 'count' FROM x
        UNION ALL SELECT 'missing_ratio', round(sum(null_count) / (max(rows) * count(*)), 6), '%' FROM x
        UNION ALL SELECT 'numeric_columns', count(*) FILTER (WHERE family = 'numeric'), 'count' FROM x
        UNION ALL SELECT 'categorical_columns', count(*) FILTER (WHERE family = 'categorical'), 'count' FROM x
        UNION ALL SELECT 'datetime_candidates', count(*) FILTER (WHERE family = 'datetime_candidate'), 'raw' FROM x)
    SELECT key, list_aggregate(list_transform(string_split(key, '_'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS label,
        value, unit, CASE unit WHEN '%' THEN '0-100%' WHEN 'count' THEN '>= 0' ELSE 'context dependent' END AS expected_range,
        CASE unit WHEN '%' THEN 'lower_is_better' ELSE 'context_only' END AS direction FROM m""",
)
def profile_metric_cards(spark, sf_dir):
    return P.metric_cards(P.dataset_metrics(_explore(spark, sf_dir)))


@query("profile_manifest", "PROF-13 SRC-8",
       f"""WITH {_EXPLORER} SELECT 3 AS dataset_id, 'Event Feed' AS dataset_name, 'dataset_3_event_feed' AS table_name,
           max(rows) AS row_count, count(*) AS column_count, CAST(sum(null_count) AS BIGINT) AS missing_values,
           'rename_columns,cast_types,fill_missing_values,drop_columns,filter_rows,sort_by,limit_rows' AS available_edits FROM x""")
def profile_manifest(spark, sf_dir):
    made = P.extraction_manifest(_view(spark, sf_dir), _explore(spark, sf_dir), 3, "Event Feed", ["event_id"])
    return made.drop("columns", "preview_rows")


@query(
    "profile_manifest_columns",
    "PROF-13",
    f"""WITH {_EXPLORER}, p AS (SELECT event_id, event_type FROM v ORDER BY event_id LIMIT 20)
        SELECT (SELECT string_agg("column" || ':' || dtype || ':' || family || ':' || null_count || ':' || unique_count, ',' ORDER BY position) FROM x) AS columns,
        (SELECT string_agg(event_id || ':' || coalesce(event_type, '-'), ',' ORDER BY event_id) FROM p) AS preview""",
)
def profile_manifest_columns(spark, sf_dir):
    made = P.extraction_manifest(_view(spark, sf_dir), _explore(spark, sf_dir), 3, "Event Feed", ["event_id"])
    shown = lambda r: F.concat_ws(":", F.get_json_object(r, "$.event_id"), F.coalesce(F.get_json_object(r, "$.event_type"), F.lit("-")))
    return made.select(
        F.array_join(F.transform("columns", lambda c: F.concat_ws(":", c["column"], c["dtype"], c["family"], c["null_count"].cast("string"), c["unique_count"].cast("string"))), ",").alias("columns"),
        F.array_join(F.transform("preview_rows", shown), ",").alias("preview"),
    )


@query(
    "profile_feature_statistics",
    "PROF-14",
    f"""WITH {_EXPLORER} SELECT "column", CASE WHEN family = 'numeric' THEN 'numeric' ELSE 'categorical' END AS family, min, max,
        round(mean, 6) AS mean, round(std, 6) AS std, mode,
        CASE WHEN family <> 'numeric' THEN unique_count END AS unique_values FROM x WHERE "column" <> 'ts'""",
)
def profile_feature_statistics(spark, sf_dir):
    stats = P.feature_statistics(_view(spark, sf_dir).drop("ts"), ["event_id"])
    return stats.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(
    "profile_fingerprint",
    "PROF-15 TXT-20",
    """
    SELECT count(*) AS rows, CAST(sum(CAST(('0x' || substr(md5(concat_ws(chr(1), CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR),
      o_orderstatus, CAST(o_totalprice AS VARCHAR), o_orderpriority)), 1, 15)) AS UBIGINT)) AS VARCHAR) AS fingerprint FROM orders
    """,
)
def profile_fingerprint(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").drop("o_orderdate").repartition(5)
    return P.table_fingerprint(orders)


@query(
    "profile_charts",
    "PROF-16",
    f"""WITH {_EXPLORER},
    m AS (SELECT 'Missing Values by Column' AS chart, row_number() OVER (ORDER BY null_count DESC, position) AS place,
          "column" AS label, CAST(null_count AS DOUBLE) AS value FROM x),
    a AS (SELECT 'Numeric Mean Snapshot' AS chart, row_number() OVER (ORDER BY position) AS place, "column" AS label,
          round(mean, 6) AS value FROM x WHERE family = 'numeric')
    SELECT chart, CAST(place AS INTEGER) AS place, label, value FROM (
      SELECT * FROM m WHERE place <= 8 UNION ALL SELECT * FROM a WHERE place <= 8 AND value IS NOT NULL
      UNION ALL SELECT 'Column Types', 1, 'Numeric', count(*) FILTER (WHERE family = 'numeric') FROM x
      UNION ALL SELECT 'Column Types', 2, 'Categorical', count(*) FILTER (WHERE family = 'categorical') FROM x
      UNION ALL SELECT 'Column Types', 3, 'Datetime', count(*) FILTER (WHERE family LIKE 'datetime%') FROM x)""",
)
def profile_charts(spark, sf_dir):
    return P.dataset_charts(_explore(spark, sf_dir)).withColumn("value", F.round("value", 6))
