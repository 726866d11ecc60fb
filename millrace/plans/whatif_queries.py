"""What-if queries: a linear score stands for the model, so SQL can check every number."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import evaluate as E
from millrace.operators import whatif as W
from millrace.plans.registry import query, table

_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]
_WEIGHTS = {"l_quantity": 1500.0, "l_discount": -200.0, "l_tax": 50.0}
_KEY = ["line"]
_PAYLOAD = {
    "scenarios": [
        {"name": "rise", "steps": 4, "amplitude": 0.2},
        {"name": "fixed", "steps": 3, "trend": "down", "overrides": {"l_quantity": 10, "l_returnflag": "X"},
         "stepPlan": {"deltas": {"l_tax": {"value": 0.5, "mode": "absolute", "trend": "up"}, "l_discount": {"value": 1.0, "mode": "target"}}, "features": ["l_tax"]}},
    ]
}


def _lines(spark, sf_dir):
    line = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(line.alias("line"), *_FEATURES)


_LINE = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line"
_GRID = f"""a AS (SELECT {_LINE}, l_quantity AS q, l_discount AS d, l_tax AS t, l_returnflag AS f FROM lineitem),
    g AS (SELECT line, 'rise' AS scenario, i AS step, q * (1 + 0.2 * i / 4.0) AS q, d * (1 + 0.2 * i / 4.0) AS d, t * (1 + 0.2 * i / 4.0) AS t, f FROM a, range(1, 5) r(i)
      UNION ALL SELECT line, 'fixed', i, 10.0, d + (1.0 - d) * (i / 3.0), t + 0.5 * (i / 3.0), 'X' FROM a, range(1, 4) r(i))"""


def _scenarios():
    return W.normalise_scenarios(_PAYLOAD, _FEATURES)


def _grid(spark, sf_dir):
    return W.step_grid(_lines(spark, sf_dir), _FEATURES, _scenarios())


@query(
    "whatif_baseline",
    "WI-1",
    """
    SELECT 'last' AS kind, o_totalprice AS price, CAST(o_custkey AS DOUBLE) AS who, o_orderstatus AS status FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)
    UNION ALL SELECT 'first', o_totalprice, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)
    UNION ALL SELECT 'mean', round(avg(o_totalprice), 4), round(avg(o_custkey), 4), (SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) FROM orders
    UNION ALL SELECT 'median', round(quantile_cont(o_totalprice, 0.5), 4), quantile_cont(o_custkey, 0.5), (SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) FROM orders
    """,
)
def whatif_baseline(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("who"), F.col("o_orderstatus").alias("status"))
    out = None
    for kind in ("last", "first", "mean", "median"):
        row = W.baseline(orders, ["price", "who", "status"], kind, ["o_orderkey"])
        row = row.select(F.lit(kind).alias("kind"), F.round("price", 4).alias("price"), F.round("who", 4).alias("who"), "status")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "whatif_overrides",
    "WI-2",
    f"SELECT {_LINE}, CAST(30.0 AS DOUBLE) AS l_quantity, l_discount, l_tax, 'Z' AS l_returnflag FROM lineitem",
)
def whatif_overrides(spark, sf_dir):
    return W.override(_lines(spark, sf_dir), {"l_quantity": 30, "l_returnflag": "Z"})


@query(
    "whatif_step_grid",
    "WI-3 WI-4",
    f"WITH {_GRID} SELECT scenario, CAST(step AS INTEGER) AS step, count(*) AS n, round(sum(q), 2) AS q, round(sum(d), 4) AS d, round(sum(t), 4) AS t, count(DISTINCT f) AS flags FROM g GROUP BY 1, 2",
)
def whatif_step_grid(spark, sf_dir):
    return _grid(spark, sf_dir).groupBy("scenario", "step").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"), F.round(F.sum("l_discount"), 4).alias("d"),
        F.round(F.sum("l_tax"), 4).alias("t"), F.count_distinct("l_returnflag").alias("flags"),
    )


@query(
    "whatif_scenario_results",
    "WI-5",
    f"""WITH {_GRID}, s AS (SELECT line, scenario, step, q * 1500 - d * 200 + t * 50 + 100 AS p FROM g)
    SELECT line, scenario, round(arg_min(p, step), 4) AS first_prediction, round(arg_max(p, step), 4) AS final_prediction, round(arg_max(p, step) - arg_min(p, step), 4) AS delta FROM s GROUP BY 1, 2""",
)
def whatif_scenario_results(spark, sf_dir):
    made = W.scenario_results(_lines(spark, sf_dir), _FEATURES, _scenarios(), W.linear_scorer(_WEIGHTS, 100.0), _KEY)
    return made.withColumns({c: F.round(c, 4) for c in ("first_prediction", "final_prediction", "delta")})


@query(
    "whatif_changed_features",
    "WI-6",
    f"""WITH a AS (SELECT {_LINE}, * FROM lineitem)
    SELECT line, 'l_quantity' AS feature, round(10.0 - l_quantity, 6) AS delta FROM a WHERE l_quantity <> 10 UNION ALL SELECT line, 'l_returnflag', NULL FROM a WHERE l_returnflag <> 'R'""",
)
def whatif_changed_features(spark, sf_dir):
    return W.changed_features(_lines(spark, sf_dir), {"l_quantity": 10, "l_returnflag": "R"}, _KEY).select("line", "feature", "delta")


@query(
    "whatif_applied_drift",
    "WI-7",
    f"""WITH {_GRID}, z AS (SELECT line, scenario, arg_max(q, step) AS q, arg_max(d, step) AS d, arg_max(t, step) AS t FROM g GROUP BY 1, 2)
    SELECT z.scenario, u.feature, round(sum(round(abs(u.move), 6)), 3) AS drift FROM z JOIN a USING (line),
      LATERAL (VALUES ('l_quantity', z.q - a.q), ('l_discount', z.d - a.d), ('l_tax', z.t - a.t)) u(feature, move) GROUP BY 1, 2""",
)
def whatif_applied_drift(spark, sf_dir):
    moved = W.applied_drift(_lines(spark, sf_dir), _FEATURES, _scenarios(), _KEY)
    return moved.groupBy("scenario", "feature").agg(F.round(F.sum("drift"), 3).alias("drift"))


@query(
    "whatif_sensitivity",
    "WI-8",
    f"""WITH a AS (SELECT {_LINE}, l_quantity AS q, l_discount AS d, l_tax AS t FROM lineitem),
    i AS (SELECT line, u.feature, round(u.impact, 4) AS impact FROM a, LATERAL (VALUES ('l_quantity', q * 0.2 * 1500), ('l_discount', -d * 0.2 * 200), ('l_tax', t * 0.2 * 50)) u(feature, impact))
    SELECT line, feature, impact + 0.0 AS impact, CAST(row_number() OVER (PARTITION BY line ORDER BY abs(impact) DESC, feature) AS INTEGER) AS rank FROM i""",
)
def whatif_sensitivity(spark, sf_dir):
    return W.sensitivity(_lines(spark, sf_dir), _FEATURES, W.linear_scorer(_WEIGHTS, 100.0), _KEY, 0.1).select("line", "feature", (F.round("impact", 4) + 0.0).alias("impact"), "rank")


@query(
    "whatif_geojson",
    "WI-9",
    """SELECT event_id, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || (event_id % 180) || '.0,' || (user_id % 90) || '.0]},"properties":{"event_id":' || event_id || '}}' AS feature
       FROM events WHERE event_id % 10 <> 0""",
)
def whatif_geojson(spark, sf_dir):
    e = F.col("event_id")
    places = table(spark, sf_dir, "events").select(
        "event_id", F.when(e % 10 != 0, (F.col("user_id") % 90).cast("string")).otherwise("unknown").alias("Latitude"), (e % 180).alias("lng")
    )
    return W.geojson_points(places, ["event_id"])


@query(
    "whatif_charts",
    "PROF-17",
    """SELECT 'Model Metrics' AS chart, s_name AS entity, 'rows' AS label, CAST(count(*) AS DOUBLE) AS value FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_name
       UNION ALL SELECT 'Model Metrics', s_name, 'mean_price', round(avg(l_extendedprice), 4) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_name
       UNION ALL SELECT 'Lifecycle Flags', s_name, 'Trained', CAST(s_acctbal > 0 AS INTEGER) FROM supplier""",
)
def whatif_charts(spark, sf_dir):
    """Chart data of models: numeric metrics without other entries, and lifecycle flags."""
    supplier = table(spark, sf_dir, "supplier")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("m"))
    metrics = F.create_map(F.lit("rows"), F.col("n").cast("string"), F.lit("mean_price"), F.col("m").cast("string"), F.lit("note"), F.lit("n/a"))
    models = rows.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("s_name", metrics.alias("metrics"))
    flags = supplier.select(F.lit("Lifecycle Flags").alias("chart"), F.col("s_name").alias("entity"), F.lit("Trained").alias("label"), (F.col("s_acctbal") > 0).cast("double").alias("value"))
    numbers = E.numeric_metrics(models, "s_name", "metrics")
    return numbers.select(F.lit("Model Metrics").alias("chart"), "entity", F.col("metric").alias("label"), "value").unionByName(flags)
