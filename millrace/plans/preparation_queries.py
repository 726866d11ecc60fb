"""Training-set preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import prepare as R
from millrace.plans.registry import query, table


@query(
    "prepare_task_type",
    "PREP-1",
    """
    SELECT 'l_linenumber' AS target, CASE WHEN count(DISTINCT l_linenumber) <= greatest(10, floor(count(*) * 0.05)) THEN 'classification' ELSE 'regression' END AS task, count(DISTINCT l_linenumber) AS distinct_values FROM lineitem
    UNION ALL SELECT 'l_orderkey', CASE WHEN count(DISTINCT l_orderkey) <= greatest(10, floor(count(*) * 0.05)) THEN 'classification' ELSE 'regression' END, count(DISTINCT l_orderkey) FROM lineitem
    UNION ALL SELECT 'l_returnflag', 'classification', count(DISTINCT l_returnflag) FROM lineitem
    UNION ALL SELECT 'l_extendedprice', 'regression', count(DISTINCT l_extendedprice) FROM lineitem
    UNION ALL SELECT 'l_tax', 'classification', count(DISTINCT l_tax) FROM lineitem
    """,
)
def prepare_task_type(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    rows = [R.infer_task(lines, c, metrics=m).select(F.lit(c).alias("target"), "task", "distinct_values")
            for c, m in (("l_linenumber", []), ("l_orderkey", []), ("l_returnflag", []), ("l_extendedprice", []), ("l_tax", ["F1"]))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query(
    "prepare_task_by_values",
    "PREP-2",
    """
    SELECT 'l_quantity' AS target, CASE WHEN sum(CAST(l_quantity <> floor(l_quantity) AS INT)) = 0 AND count(DISTINCT l_quantity) <= greatest(20, floor(count(*) * 0.05)) THEN 'classification' ELSE 'regression' END AS task FROM lineitem
    UNION ALL SELECT 'l_discount', CASE WHEN sum(CAST(l_discount <> floor(l_discount) AS INT)) = 0 AND count(DISTINCT l_discount) <= greatest(20, floor(count(*) * 0.05)) THEN 'classification' ELSE 'regression' END FROM lineitem
    """,
)
def prepare_task_by_values(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    first, second = (R.infer_task_by_values(lines, c).select(F.lit(c).alias("target"), "task") for c in ("l_quantity", "l_discount"))
    return first.unionByName(second)


def _mixed(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate",
        F.when(k % 6 != 0, F.col("o_totalprice")).alias("price"),
        F.when(k % 9 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        F.when(k % 4 != 0, F.col("o_orderstatus")).alias("status"),
        F.lit(None).cast("double").alias("empty"),
    )


@query(
    "prepare_encode_features",
    "PREP-3 PREP-4 PREP-5",
    """
    WITH a AS (SELECT o_orderkey, epoch(o_orderdate) AS t, CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice END AS price,
        CASE WHEN o_orderkey % 9 <> 0 THEN epoch(o_orderdate) END AS d, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS status FROM orders)
    SELECT o_orderkey, t AS o_orderdate, round(coalesce(price, (SELECT avg(price) FROM a)), 4) AS price,
      round(coalesce(d, (SELECT avg(d) FROM a)), 2) AS day,
      CAST(coalesce(status = 'F', false) AS DOUBLE) AS status_F, CAST(coalesce(status = 'O', false) AS DOUBLE) AS status_O,
      CAST(coalesce(status = 'P', false) AS DOUBLE) AS status_P, CAST(status IS NULL AS DOUBLE) AS status_nan,
      CAST(0 AS DOUBLE) AS empty FROM a
    """,
)
def prepare_encode_features(spark, sf_dir):
    frame = _mixed(spark, sf_dir)
    encoding = R.fit_features(frame, ["o_orderdate", "price", "day", "status", "empty"])
    made = encoding.transform(frame, keep=["o_orderkey"])
    return made.withColumns({"price": F.round("price", 4), "day": F.round("day", 2)})


_CUSTOMER_BLOCKS = """
    b AS (SELECT c_custkey, c_acctbal, c_name, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer),
    f AS (SELECT * FROM b WHERE {0}),
    n AS (SELECT c_name AS value, row_number() OVER (ORDER BY c_name) - 1 AS code FROM (SELECT DISTINCT c_name FROM f WHERE c_name IS NOT NULL)),
    m AS (SELECT seg AS value, row_number() OVER (ORDER BY seg) - 1 AS code FROM (SELECT DISTINCT seg FROM f WHERE seg IS NOT NULL)),
    k AS (SELECT (SELECT count(*) FROM n) AS names, (SELECT count(*) FROM m) AS segs),
    e AS (SELECT c_custkey, 0 AS position, c_acctbal AS value FROM b
      UNION ALL SELECT c_custkey, 1 + code, 1.0 FROM b JOIN n ON n.value = c_name UNION ALL SELECT c_custkey, 1 + names, 1.0 FROM b, k WHERE c_name IS NULL
      UNION ALL SELECT c_custkey, 2 + names + code, 1.0 FROM k, b JOIN m ON m.value = seg UNION ALL SELECT c_custkey, 2 + names + segs, 1.0 FROM b, k WHERE seg IS NULL)
    SELECT c_custkey, CAST(position AS BIGINT) AS position, CAST(value AS DOUBLE) AS value FROM e WHERE value <> 0"""


def _customers(spark, sf_dir):
    segment = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name", "c_acctbal", segment)


@query("prepare_wide_features", "PREP-4", "WITH" + _CUSTOMER_BLOCKS.format("true"))
def prepare_wide_features(spark, sf_dir):
    """Text columns of any number of values as sparse blocks: one row per non-zero position."""
    frame = _customers(spark, sf_dir)
    return R.fit_features(frame, ["c_name", "c_acctbal", "c_mktsegment"]).entries(frame, ["c_custkey"])


@query("prepare_encode_unseen", "PREP-4", "WITH" + _CUSTOMER_BLOCKS.format("c_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)"))
def prepare_encode_unseen(spark, sf_dir):
    """Learnt on the customers of some nations, applied to all: unseen names fill no position."""
    frame = _customers(spark, sf_dir)
    return R.fit_features(frame.where("c_nationkey < 12"), ["c_name", "c_acctbal", "c_mktsegment"]).entries(frame, ["c_custkey"])


@query(
    "prepare_class_target",
    "PREP-6",
    """
    WITH a AS (SELECT o_orderkey, nullif(o_orderpriority, '3-MEDIUM') AS label, nullif(o_custkey % 12, 5) AS number FROM orders),
    c AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT label FROM a WHERE label IS NOT NULL)),
    d AS (SELECT number, row_number() OVER (ORDER BY number) - 1 AS code FROM (SELECT DISTINCT number FROM a WHERE number IS NOT NULL))
    SELECT o_orderkey, CAST(coalesce(c.code, -1) AS INTEGER) AS label_encoded, CAST(coalesce(d.code, -1) AS INTEGER) AS number_encoded
    FROM a LEFT JOIN c USING (label) LEFT JOIN d USING (number)
    """,
)
def prepare_class_target(spark, sf_dir):
    frame = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.expr("nullif(o_orderpriority, '3-MEDIUM')").alias("label"), F.expr("nullif(o_custkey % 12, 5)").alias("number")
    )
    return R.encode_targets(frame, ["label", "number"], "classification").drop("label", "number")


@query(
    "prepare_numeric_targets",
    "PREP-7 PREP-8",
    """
    WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS who FROM orders)
    SELECT o_orderkey, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM a)), 4) AS price_encoded,
           round(coalesce(who, (SELECT quantile_cont(who, 0.5) FROM a)), 4) AS who_encoded FROM a
    """,
)
def prepare_numeric_targets(spark, sf_dir):
    k = F.col("o_orderkey")
    frame = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 5 != 0, F.col("o_totalprice").cast("string")).otherwise("?").alias("price"),
        F.when(k % 3 != 0, F.col("o_custkey")).alias("who"),
    )
    made = R.encode_targets(frame, ["price", "who"], "regression").drop("price", "who")
    return made.withColumns({"price_encoded": F.round("price_encoded", 4), "who_encoded": F.round("who_encoded", 4)})


@query(
    "prepare_hash_split",
    "PREP-9",
    """SELECT o_orderkey, o_totalprice,
        CAST(('0x' || substr(md5('42' || chr(1) || CAST(o_orderkey AS VARCHAR)), 1, 8)) AS UBIGINT) / 4294967296.0 < 0.2 AS is_test FROM orders""",
)
def prepare_hash_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return R.hash_split(orders, ["o_orderkey"])


@query(
    "prepare_stratified_split",
    "PREP-10",
    """
    SELECT o_orderpriority, count(*) AS n, CAST(ceil(count(*) * 0.2) AS BIGINT) AS test_rows, true AS stratified FROM orders GROUP BY o_orderpriority
    """,
)
def prepare_stratified_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    split = R.stratified_split(orders, "o_orderpriority", ["o_orderkey"])
    possible = R.can_stratify(orders, "o_orderpriority").select("stratified").scalar()
    return split.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("test_rows")).withColumn("stratified", possible)


@query(
    "prepare_preflight",
    "FW-31",
    """
    SELECT false AS ok, 'o_custkey,o_totalprice,age' AS input_features, 'o_orderstatus' AS output_features, 'age' AS missing_columns,
      'o_orderpriority' AS recommended_output, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate' AS recommended_inputs,
      count(*) AS rows FROM orders
    """,
)
def prepare_preflight(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    facts = R.preflight(orders, ["o_custkey", "o_totalprice", "o_orderstatus", "age"], ["o_orderstatus"])
    return facts.withColumn("rows", orders.agg(F.count(F.lit(1)).alias("n")).scalar())
