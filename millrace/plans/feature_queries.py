"""Feature workspace queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import features as X
from millrace.plans.registry import query, table


@query(
    "feature_flagship",
    "FW-1 FW-12 FW-20 FW-21 FW-22 FW-25 FW-26",
    """
    WITH a AS (SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_returnflag, l_shipdate,
                      l_extendedprice * (1 - l_discount) AS net FROM lineitem),
         s AS (SELECT min(net) AS lo, max(net) AS hi FROM a)
    SELECT order_id, line_no, round(net, 4) AS net, round((net - lo) / (hi - lo), 6) AS net_scaled
    FROM a, s
    WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1999-12-31' AND l_returnflag = 'R'
    ORDER BY a.net DESC NULLS LAST, order_id, line_no LIMIT 100
    """,
)
def feature_flagship(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"
    ).withColumn("kept", F.lit(1) - F.col("l_discount"))
    result = X.apply_feature_operations(
        lines,
        {
            "limit_rows": 100,
            "sort_by": {"column": "net", "ascending": False},
            "filters": [{"column": "l_returnflag", "operator": "eq", "value": "R"}],
            "date_range_filters": [{"column": "l_shipdate", "start": "1996-01-01", "end": "1999-12-31"}],
            "normalize": [{"columns": ["net"], "suffix": "_scaled"}],
            "math_operations": [
                {"column": "l_extendedprice", "operator": "multiply", "right_column": "kept", "target": "net"}
            ],
            "rename_columns": {"l_orderkey": "order_id", "l_linenumber": "line_no"},
        },
        tie_break=["order_id", "line_no"],
    ).frame
    return result.select("order_id", "line_no", F.round("net", 4).alias("net"), F.round("net_scaled", 6).alias("net_scaled"))


@query(
    "feature_rename_drop",
    "FW-1 FW-2 FW-30",
    "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderpriority FROM orders",
)
def feature_rename_drop(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    X.require_columns(orders, ["o_orderkey", "o_custkey"])
    return X.apply_feature_operations(
        orders,
        {
            "rename_columns": {"o_orderkey": "order_id", "o_custkey": "customer_id", "unknown": "ignored"},
            "drop_columns": ["o_totalprice", "o_orderdate", "o_orderstatus", "not_there"],
        },
    ).frame


@query(
    "feature_casts",
    "FW-3 FW-4 FW-5 FW-6 FW-7",
    r"""
    WITH a AS (SELECT event_id, value, props, event_type,
        CASE WHEN event_id % 5 = 0 THEN 'bad' ELSE CAST(value AS VARCHAR) END AS amount_text,
        CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%m/%d/%Y')
             WHEN 2 THEN strftime(ts, '%Y%m%d') ELSE 'never' END AS when_text,
        CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'no' ELSE 'perhaps' END AS flag_text FROM events)
    SELECT event_id,
        CASE WHEN value = floor(value) THEN CAST(value AS BIGINT) END AS as_long,
        TRY_CAST(amount_text AS DOUBLE) AS as_double,
        strftime(CASE event_id % 4 WHEN 0 THEN TRY_CAST(when_text AS TIMESTAMP)
             WHEN 1 THEN try_strptime(when_text, '%m/%d/%Y') WHEN 2 THEN try_strptime(when_text, '%Y%m%d') END,
             '%Y-%m-%d %H:%M:%S') AS as_time,
        CAST(event_id AS VARCHAR) AS as_text,
        CASE flag_text WHEN 'true' THEN true WHEN 'no' THEN false END AS as_flag
    FROM a
    """,
)
def feature_casts(spark, sf_dir):
    k = F.col("event_id")
    text = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("value").alias("as_long"),
        F.when(k % 5 == 0, "bad").otherwise(F.col("value").cast("string")).alias("as_double"),
        F.when(k % 4 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(k % 4 == 1, F.date_format("ts", "MM/dd/yyyy"))
        .when(k % 4 == 2, F.date_format("ts", "yyyyMMdd"))
        .otherwise("never").alias("as_time"),
        k.alias("as_text"),
        F.when(k % 3 == 0, "true").when(k % 3 == 1, "no").otherwise("perhaps").alias("as_flag"),
    )
    kinds = {"as_long": "integer", "as_double": "number", "as_time": "datetime", "as_text": "text", "as_flag": "bool"}
    return X.apply_feature_operations(text, {"cast_types": kinds}).frame.withColumn(
        "as_time", F.date_format("as_time", "yyyy-MM-dd HH:mm:ss")
    )


@query(
    "feature_fill",
    "FW-8 FW-9 FW-10 FW-11",
    """
    WITH a AS (SELECT l_orderkey, l_linenumber, nullif(l_linenumber, 3) AS by_literal,
            nullif(l_quantity, 50.0) AS by_mean, nullif(l_tax, 0.0) AS by_median,
            nullif(l_returnflag, 'N') AS by_mode FROM lineitem),
         s AS (SELECT avg(by_mean) AS m, quantile_cont(by_median, 0.5) AS q FROM a),
         d AS (SELECT by_mode AS v FROM a WHERE by_mode IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT l_orderkey, l_linenumber, coalesce(by_literal, -1) AS by_literal,
           round(coalesce(by_mean, m), 6) AS by_mean, coalesce(by_median, q) AS by_median,
           coalesce(by_mode, v) AS by_mode FROM a, s, d
    """,
)
def feature_fill(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.expr("nullif(l_linenumber, 3)").alias("by_literal"),
        F.expr("nullif(l_quantity, 50.0D)").alias("by_mean"),
        F.expr("nullif(l_tax, 0.0D)").alias("by_median"),
        F.expr("nullif(l_returnflag, 'N')").alias("by_mode"),
    )
    plan = {
        "by_literal": -1,
        "by_mean": {"strategy": "mean"},
        "by_median": {"strategy": "median"},
        "by_mode": {"strategy": "mode"},
    }
    filled = X.apply_feature_operations(lines, {"fill_missing_values": plan}).frame
    return filled.withColumn("by_mean", F.round("by_mean", 6))


@query(
    "feature_math",
    "FW-12 FW-13 FW-14 FW-15 FW-16 FW-17 FW-18 FW-19",
    """
    SELECT l_orderkey, l_linenumber,
        round(l_extendedprice + l_tax, 4) AS added, round(l_quantity - 25, 4) AS subtracted,
        round(l_extendedprice * 0.5, 4) AS multiplied,
        round(l_extendedprice / nullif(l_discount, 0), 4) AS divided, round(l_quantity / 4, 4) AS quartered,
        round(power(l_quantity, 2), 4) AS squared,
        CAST(round_even(l_quantity / 4, 0) AS DOUBLE) AS rounded,
        CASE WHEN l_quantity < 10 THEN 10 ELSE l_quantity END AS floored,
        CASE WHEN l_quantity > 40 THEN 40 ELSE l_quantity END AS capped,
        abs(l_quantity - 25) AS magnitude,
        round(ln(1 + greatest(l_quantity - 25, 0)), 6) AS logged,
        l_quantity >= 6 AS overflowed
    FROM lineitem
    """,
)
def feature_math(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    ops = [
        {"column": "l_extendedprice", "operator": "add", "right_column": "l_tax", "target": "added"},
        {"column": "l_quantity", "operator": "subtract", "value": "25", "target": "subtracted"},
        {"column": "l_extendedprice", "operator": "multiply", "value": 0.5, "target": "multiplied"},
        {"column": "l_extendedprice", "operator": "divide", "right_column": "l_discount", "target": "divided"},
        {"column": "l_quantity", "operator": "divide", "value": 4, "target": "quartered"},
        {"column": "l_quantity", "operator": "divide", "value": 0, "target": "skipped"},
        {"column": "l_quantity", "operator": "power", "value": 2, "target": "squared"},
        {"column": "quartered", "operator": "round", "target": "rounded"},
        {"column": "l_quantity", "operator": "clip_min", "value": 10, "target": "floored"},
        {"column": "l_quantity", "operator": "clip_max", "value": 40, "target": "capped"},
        {"column": "subtracted", "operator": "abs", "target": "magnitude"},
        {"column": "subtracted", "operator": "log1p", "target": "logged"},
        {"column": "l_quantity", "operator": "power", "value": 400, "target": "overflowed"},
    ]
    made = X.apply_feature_operations(lines, {"math_operations": ops}).frame
    four = ["added", "subtracted", "multiplied", "divided", "quartered", "squared"]
    return made.drop("l_quantity", "l_extendedprice", "l_discount", "l_tax").withColumns(
        {**{c: F.round(c, 4) for c in four}, "logged": F.round("logged", 6), "overflowed": F.isnull("overflowed")}
    )


@query(
    "feature_normalise",
    "FW-20",
    """
    WITH a AS (SELECT l_orderkey, l_linenumber, nullif(l_quantity, 50.0) AS quantity, l_extendedprice AS price,
                      CASE WHEN l_linenumber = 2 THEN NULL ELSE 7.0::DOUBLE END AS constant FROM lineitem),
         s AS (SELECT min(quantity) a, max(quantity) b, min(price) c, max(price) d FROM a)
    SELECT l_orderkey, l_linenumber, round((quantity - s.a) / (s.b - s.a) * 2 - 1, 6) AS quantity,
           round((price - c) / (d - c) * 2 - 1, 6) AS price, CAST(-1.0 AS DOUBLE) AS constant FROM a, s
    """,
)
def feature_normalise(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.expr("nullif(l_quantity, 50.0D)").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.expr("CASE WHEN l_linenumber = 2 THEN NULL ELSE 7.0D END").alias("constant"),
    )
    made = X.apply_feature_operations(
        lines, {"normalize": {"columns": "quantity, price, constant", "min": -1, "max": 1}}
    ).frame
    return made.withColumns({"quantity": F.round("quantity", 6), "price": F.round("price", 6)})


@query(
    "feature_date_range",
    "FW-21",
    r"""
    WITH a AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS seen,
               date_trunc('second', ts) AS t FROM events)
    SELECT event_id, seen FROM a WHERE event_id % 7 <> 0 AND t >= TIMESTAMP '2024-01-05' AND t <= TIMESTAMP '2024-01-20'
    """,
)
def feature_date_range(spark, sf_dir):
    seen = F.when(F.col("event_id") % 7 == 0, "unknown").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    events = table(spark, sf_dir, "events").select("event_id", seen.alias("seen"))
    return X.apply_feature_operations(
        events, {"date_range_filters": [{"column": "seen", "start": "2024-01-05", "end": "2024-01-20"}]}
    ).frame


def _filtered(conditions):
    def run(spark, sf_dir):
        lines = table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_quantity", F.expr("nullif(l_tax, 0.0D)").alias("tax"),
            F.expr("nullif(l_returnflag, 'A')").alias("flag"),
        )
        return X.apply_feature_operations(lines, {"filters": conditions}).frame

    return run


_NULLABLE_LINES = (
    "SELECT * FROM (SELECT l_orderkey, l_linenumber, l_quantity, nullif(l_tax, 0.0) AS tax, "
    "nullif(l_returnflag, 'A') AS flag FROM lineitem) WHERE "
)

query("feature_filter_compare", "FW-22", _NULLABLE_LINES + "l_quantity >= 20 AND tax > 0.02 AND l_linenumber <= 4 AND flag = 'R' AND l_quantity < 45")(
    _filtered([
        {"column": "l_quantity", "operator": "gte", "value": 20},
        {"column": "tax", "operator": "gt", "value": "0.02"},
        {"column": "l_linenumber", "operator": "lte", "value": 4},
        {"column": "flag", "operator": "eq", "value": "R"},
        {"column": "l_quantity", "operator": "lt", "value": 45},
    ])
)
query("feature_filter_not_equal", "FW-23", _NULLABLE_LINES + "tax IS DISTINCT FROM 0.05 AND flag IS DISTINCT FROM 'R'")(
    _filtered([
        {"column": "tax", "operator": "neq", "value": 0.05},
        {"column": "flag", "operator": "!=", "value": "R"},
    ])
)


@query(
    "feature_filter_contains",
    "FW-24",
    "SELECT doc_id, lang, source FROM documents WHERE regexp_matches(text, '(?i)(éle|ing) ')",
)
def feature_filter_contains(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return X.apply_feature_operations(
        docs, {"filters": [{"column": "text", "operator": "contains", "value": "(ÉLE|ING) "}]}
    ).frame.drop("text")


@query(
    "feature_sort_limit",
    "FW-25 FW-26 FW-28 FW-29",
    """
    SELECT o_orderkey, o_custkey, total FROM
      (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS total FROM orders)
    ORDER BY total ASC NULLS LAST, o_orderkey LIMIT 250
    """,
)
def feature_sort_limit(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("total")
    )
    request = X.operations_from_visual(
        {"transforms": [
            {"type": "limit", "value": X.clamp_preview("250")},
            {"type": "sort", "column": "total", "ascending": True},
        ]}
    )
    return X.apply_feature_operations(orders, request, tie_break=["o_orderkey"]).frame


@query(
    "feature_visual_payload",
    "FW-28",
    """
    SELECT o_orderkey AS id, o_orderstatus, round(o_totalprice / 1000, 6) AS thousands
    FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000
      AND o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-12-31'
    """,
)
def feature_visual_payload(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    request = X.operations_from_visual(
        {"transforms": [
            {"type": "filter", "column": "o_orderstatus", "operator": "==", "value": "F"},
            {"type": "filter", "column": "o_totalprice", "operator": ">", "value": "100000"},
            {"type": "date_range", "column": "o_orderdate", "start": "1997-01-01", "end": "1998-12-31"},
            {"type": "math", "column": "o_totalprice", "operator": "divide", "value": 1000, "target": "thousands"},
            {"type": "rename", "column": "o_orderkey", "value": "id"},
        ]}
    )
    made = X.apply_feature_operations(orders, request).frame
    return made.select("id", "o_orderstatus", F.round("thousands", 6).alias("thousands"))


@query(
    "feature_change_summary",
    "FW-27",
    """
    SELECT (SELECT count(*) FROM lineitem) AS rows_before, 11 AS columns_before,
           (SELECT count(*) FROM lineitem WHERE l_quantity > 30) AS rows_after, 10 AS columns_after,
           2 AS step_count, 'drop_columns,filter_rows' AS steps
    """,
)
def feature_change_summary(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    made = X.apply_feature_operations(
        lines, {"drop_columns": ["l_tax"], "filters": [{"column": "l_quantity", "operator": "gt", "value": 30}]}
    )
    return X.change_summary(lines, made.frame, made.steps)


_CHANGE = {"drop_columns": ["o_custkey"], "filters": [{"column": "o_totalprice", "operator": "gt", "value": 1000}], "math_operations": [
    {"column": "o_totalprice", "operator": "divide", "value": 2, "target": "half"}]}


def _change_report(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return X.change_report(orders, X.apply_feature_operations(orders, _CHANGE), ["o_orderkey"])


@query(
    "feature_change_preview",
    "FW-27",
    "SELECT o_orderkey, o_orderstatus, o_totalprice, o_totalprice / 2 AS half FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey LIMIT 20",
)
def feature_change_preview(spark, sf_dir):
    """The first 20 rows of a changed table: the preview of the summary."""
    return _change_report(spark, sf_dir).preview


@query(
    "feature_change_explorer",
    "FW-27",
    """WITH a AS (SELECT *, o_totalprice / 2 AS half FROM orders WHERE o_totalprice > 1000)
    SELECT 'o_orderkey' AS "column", 'numeric' AS family, count(*) - count(o_orderkey) AS null_count, count(DISTINCT o_orderkey) AS unique_count, count(*) AS rows FROM a
    UNION ALL SELECT 'o_orderstatus', 'categorical', count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus), count(*) FROM a
    UNION ALL SELECT 'o_totalprice', 'numeric', count(*) - count(o_totalprice), count(DISTINCT o_totalprice), count(*) FROM a
    UNION ALL SELECT 'half', 'numeric', count(*) - count(half), count(DISTINCT half), count(*) FROM a""",
)
def feature_change_explorer(spark, sf_dir):
    return _change_report(spark, sf_dir).explorer.select("column", "family", "null_count", "unique_count", "rows")
