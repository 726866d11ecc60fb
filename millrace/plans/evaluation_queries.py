"""Evaluation, drift and retraining queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import drift as D
from millrace.operators import evaluate as E
from millrace.plans.registry import query, table

SPLIT = "1999-01-01"
_FORECAST = "(SELECT l_extendedprice AS y, l_quantity * 1500 + 1000 AS p FROM lineitem)"


def _forecast(spark, sf_dir):
    """Price of a line guessed from its quantity."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500 + 1000).alias("p"))


def _regression_sql(source: str, prefix: str = "") -> str:
    names = ("rmse", "mse", "mae", "mape", "r2")
    body = f"""m AS (SELECT avg(y) AS a FROM {source}), s AS (SELECT
        sqrt(avg((y - p) * (y - p))) AS rmse, avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae,
        avg(abs(y - p) / greatest(abs(y), 1e-8)) * 100 AS mape,
        1 - sum((y - p) * (y - p)) / sum((y - a) * (y - a)) AS r2 FROM {source}, m)"""
    return body, " UNION ALL ".join(f"SELECT '{prefix}{n}' AS metric, {n} AS value FROM s" for n in names)


_REG_CTE, _REG_ROWS = _regression_sql(_FORECAST)


@query("eval_regression", "EV-1", f"WITH {_REG_CTE} SELECT metric, round(value, 4) AS value FROM ({_REG_ROWS})")
def eval_regression(spark, sf_dir):
    return E.regression_metrics(_forecast(spark, sf_dir), "y", "p").withColumn("value", F.round("value", 4))


_LABELLED = "(SELECT l.quality AS y, CASE WHEN d.n_chars > 1500 THEN 1 WHEN d.n_chars < 60 THEN 2 ELSE l.toxic END AS p FROM labels l JOIN documents d USING (doc_id))"


def _labelled(spark, sf_dir):
    """Quality labels against a guess from length, with a third guess that is never a label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    guess = F.when(F.col("n_chars") > 1500, 1).when(F.col("n_chars") < 60, 2).otherwise(F.col("toxic"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("quality").alias("y"), guess.alias("p"))


def _class_sql(average: str) -> str:
    pick = {
        "macro": "avg(pr) AS precision, avg(re) AS recall, avg(f) AS f1",
        "weighted": "sum(pr * actual) / sum(actual) AS precision, sum(re * actual) / sum(actual) AS recall, sum(f * actual) / sum(actual) AS f1",
        "micro": "sum(hits) / sum(predicted) AS precision, sum(hits) / sum(actual) AS recall, sum(hits) / sum(actual) AS f1",
    }[average]
    return f"""WITH t AS {_LABELLED}, c AS (SELECT DISTINCT y AS label FROM t UNION SELECT DISTINCT p FROM t),
    k AS (SELECT label, (SELECT count(*) FROM t WHERE y = label AND p = label) AS hits,
        (SELECT count(*) FROM t WHERE p = label) AS predicted, (SELECT count(*) FROM t WHERE y = label) AS actual FROM c),
    x AS (SELECT *, coalesce(hits / nullif(predicted, 0), 0) AS pr, coalesce(hits / nullif(actual, 0), 0) AS re,
        coalesce(2 * hits / nullif(predicted + actual, 0), 0) AS f FROM k),
    s AS (SELECT sum(hits) / sum(actual) AS accuracy, {pick} FROM x)
    SELECT '{average}' AS average, metric, round(value, 6) AS value FROM (
      SELECT 'accuracy' AS metric, accuracy AS value FROM s UNION ALL SELECT 'precision', precision FROM s
      UNION ALL SELECT 'recall', recall FROM s UNION ALL SELECT 'f1', f1 FROM s)"""


for _average in ("macro", "weighted", "micro"):

    def _run(spark, sf_dir, average=_average):
        scores = E.classification_metrics(_labelled(spark, sf_dir), "y", "p", average)
        return scores.select(F.lit(average).alias("average"), "metric", F.round("value", 6).alias("value"))

    query(f"eval_classification_{_average}", "EV-2", _class_sql(_average))(_run)


@query(
    "eval_prefix_direction",
    "EV-3 EV-4",
    f"""WITH {_REG_CTE} SELECT 'eval_' || metric AS metric, round(value, 4) AS value, metric = 'r2' AS higher_is_better FROM ({_REG_ROWS})""",
)
def eval_prefix_direction(spark, sf_dir):
    table_ = E.evaluate(_forecast(spark, sf_dir), "y", "p", "regression", "eval_")
    return table_.select("metric", F.round("value", 4).alias("value"), E.higher_is_better(F.col("metric")).alias("higher_is_better"))


@query(
    "eval_metric_choice",
    "EV-5",
    f"""WITH {_REG_CTE} SELECT metric, round(value, 4) AS value, 'rmse' AS objective FROM ({_REG_ROWS}) WHERE metric IN ('rmse', 'r2')""",
)
def eval_metric_choice(spark, sf_dir):
    """Of the requested metrics only those that fit the task are kept."""
    chosen = E.resolve_metrics(spark, "regression", ["RMSE", "accuracy", "r2"], "f1").where("accepted")
    scores = E.regression_metrics(_forecast(spark, sf_dir), "y", "p")
    return scores.join(chosen, "metric").select("metric", F.round("value", 4).alias("value"), "objective")


@query(
    "eval_output_summary",
    "ML-7",
    """SELECT count(*) AS output_rows, 2 AS output_columns,
       (SELECT round(avg(x), 4) FROM (SELECT l_quantity AS x FROM lineitem UNION ALL SELECT l_discount FROM lineitem)) AS output_mean,
       (SELECT round(stddev_pop(x), 4) FROM (SELECT l_quantity AS x FROM lineitem UNION ALL SELECT l_discount FROM lineitem)) AS output_std
       FROM lineitem""",
)
def eval_output_summary(spark, sf_dir):
    summary = E.output_summary(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])
    return summary.withColumns({"output_mean": F.round("output_mean", 4), "output_std": F.round("output_std", 4)})


_WATCHED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _periods(spark, sf_dir):
    """Lines shipped before and after the split; the later period has a shifted quantity."""
    lines = table(spark, sf_dir, "lineitem").select(*_WATCHED, "l_returnflag", "l_shipdate")
    day = F.lit(SPLIT).cast("timestamp_ntz")
    before = lines.where(F.col("l_shipdate") < day).drop("l_shipdate")
    after = lines.where(F.col("l_shipdate") >= day).drop("l_shipdate").withColumn("l_quantity", F.col("l_quantity") + 1)
    return before, after.withColumn("l_tax", F.expr("nullif(l_tax, 0.0D)"))


def _gap_sql(column: str) -> str:
    now = {"l_quantity": "l_quantity + 1", "l_tax": "nullif(l_tax, 0.0)"}.get(column, column)
    return f"""SELECT '{column}' AS "column", max(n_reference) AS n_reference, max(n_current) AS n_current, max(abs(r / n_reference - c / n_current)) AS distance FROM (
      SELECT v, sum(a) OVER (ORDER BY v) AS r, sum(b) OVER (ORDER BY v) AS c, sum(a) OVER () AS n_reference, sum(b) OVER () AS n_current FROM (
        SELECT v, sum(a) AS a, sum(b) AS b FROM (
          SELECT {column} AS v, 1 AS a, 0 AS b FROM lineitem WHERE l_shipdate < TIMESTAMP '{SPLIT}' AND {column} IS NOT NULL
          UNION ALL SELECT {now}, 0, 1 FROM lineitem WHERE l_shipdate >= TIMESTAMP '{SPLIT}' AND {now} IS NOT NULL) GROUP BY v))"""


_GAPS = "g AS (" + " UNION ALL ".join(_gap_sql(c) for c in _WATCHED) + ")"
#: Samples of up to 10,000 values: chance that a random order of both samples lies as far apart, step by step.
_EXACT = """x AS (SELECT *, CAST(n_reference AS BIGINT) AS n, CAST(n_current AS BIGINT) AS m, CAST(round(distance * n_reference * n_current) AS BIGINT) AS h
      FROM g WHERE greatest(n_reference, n_current) <= 10000),
    w AS (SELECT {key}, n, m, h, CAST(0 AS BIGINT) AS t, list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS v, CAST(0 AS DOUBLE) AS gone FROM x
      UNION ALL
      SELECT {key}, n, m, h, t + 1, list_transform(range(0, n + 1), lambda i: CASE WHEN abs(i * m - (t + 1 - i) * n) < h THEN u[i + 1] ELSE 0.0 END),
        gone + list_sum(list_transform(range(0, n + 1), lambda i: CASE WHEN abs(i * m - (t + 1 - i) * n) < h THEN 0.0 ELSE u[i + 1] END)) FROM (
          SELECT *, list_transform(range(0, n + 1), lambda i: v[i + 1] * (m - t + i) / (n + m - t) + CASE WHEN i > 0 THEN v[i] * (n - i + 1) / (n + m - t) ELSE 0.0 END) AS u
          FROM w WHERE t < n + m)),
    e AS (SELECT {key}, CASE WHEN h <= 0 THEN 1.0 ELSE least(1.0, gone) END AS exact FROM w WHERE t = n + m)"""


def _tail_sql(key: str = '"column"') -> str:
    return _EXACT.format(key=key) + f""",
    t AS (SELECT *, (sqrt(n_reference * n_current / (n_reference + n_current)) + 0.12
      + 0.11 / sqrt(n_reference * n_current / (n_reference + n_current))) * distance AS lam FROM g LEFT JOIN e USING ({key})),
    p AS (SELECT *, CASE WHEN exact IS NOT NULL THEN exact WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum(list_transform(range(1, 101),
      lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * lam * lam))))) END AS p_value FROM t)"""


_TAIL = _tail_sql()


@query(
    "drift_features",
    "DR-1",
    f"""WITH RECURSIVE {_GAPS}, {_TAIL} SELECT "column", CAST(n_reference AS BIGINT) AS n_reference, CAST(n_current AS BIGINT) AS n_current,
        round(distance, 9) AS distance, round(p_value, 6) AS p_value, p_value < 0.05 AS drifted FROM p""",
)
def drift_features(spark, sf_dir):
    found = D.feature_drift(*_periods(spark, sf_dir))
    return found.withColumns({"distance": F.round("distance", 9), "p_value": F.round("p_value", 6)})


@query(
    "drift_predictions",
    "DR-2",
    f"""WITH RECURSIVE g AS ({_gap_sql('l_extendedprice')}), {_TAIL} SELECT round(distance, 9) AS distance, round(p_value, 6) AS p_value, p_value < 0.05 AS drifted FROM p""",
)
def drift_predictions(spark, sf_dir):
    before, after = (p.select(F.col("l_extendedprice").alias("prediction")) for p in _periods(spark, sf_dir))
    found = D.prediction_drift(before, after)
    return found.withColumns({"distance": F.round("distance", 9), "p_value": F.round("p_value", 6)})


_USER_GAPS = """g AS (SELECT user_id, event_type, max(n_reference) AS n_reference, max(n_current) AS n_current, max(abs(r / n_reference - c / n_current)) AS distance FROM (
      SELECT user_id, event_type, sum(a) OVER k AS r, sum(b) OVER k AS c, sum(a) OVER (PARTITION BY user_id, event_type) AS n_reference, sum(b) OVER (PARTITION BY user_id, event_type) AS n_current FROM (
        SELECT user_id, event_type, value, count(*) FILTER (half = 0) AS a, count(*) FILTER (half = 1) AS b FROM (
          SELECT user_id, event_type, value, event_id % 2 AS half FROM events WHERE value IS NOT NULL) GROUP BY ALL)
      WINDOW k AS (PARTITION BY user_id, event_type ORDER BY value)) WHERE n_reference > 0 AND n_current > 0 GROUP BY 1, 2)"""


@query(
    "drift_small_samples",
    "DR-1",
    f"""WITH RECURSIVE {_USER_GAPS}, {_tail_sql("user_id, event_type")} SELECT user_id, event_type, CAST(n_reference AS BIGINT) AS n_reference, CAST(n_current AS BIGINT) AS n_current,
        round(distance, 9) AS distance, round(p_value, 9) AS p_value, p_value < 0.05 AS drifted FROM p""",
)
def drift_small_samples(spark, sf_dir):
    """Every user's values of an event type, events with an even number against the others: few values each, exact test."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    halves = (events.where(F.col("event_id") % 2 == rest).drop("event_id") for rest in (0, 1))
    found = D.feature_drift(*halves, columns=["value"], by=["user_id", "event_type"]).drop("column")
    return found.withColumns({"distance": F.round("distance", 9), "p_value": F.round("p_value", 9)})


def _period_metrics(spark, sf_dir):
    """Forecast quality per period, the later one with a worse forecast."""
    lines = table(spark, sf_dir, "lineitem").select("l_shipdate", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    day = F.lit(SPLIT).cast("timestamp_ntz")
    previous = E.regression_metrics(lines.where(F.col("l_shipdate") < day), "y", "p")
    current = E.regression_metrics(lines.where(F.col("l_shipdate") >= day).withColumn("p", F.col("p") * 1.2), "y", "p")
    return current, previous


_OLD = f"(SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem WHERE l_shipdate < TIMESTAMP '{SPLIT}')"
_NEW = f"(SELECT l_extendedprice AS y, l_quantity * 1500 * 1.2 AS p FROM lineitem WHERE l_shipdate >= TIMESTAMP '{SPLIT}')"
_OLD_CTE, _OLD_ROWS = _regression_sql(_OLD)
_NEW_CTE, _NEW_ROWS = _regression_sql(_NEW)
_DEGRADED = f"""o AS (WITH {_OLD_CTE} {_OLD_ROWS}), n AS (WITH {_NEW_CTE} {_NEW_ROWS}),
    d AS (SELECT n.metric, n.value AS current, o.value AS previous,
      CASE WHEN n.metric = 'r2' THEN n.value < o.value * 0.95 ELSE n.value > o.value * 1.05 END AS degraded FROM n JOIN o USING (metric))"""


@query(
    "drift_degradation",
    "DR-3",
    f"WITH {_DEGRADED} SELECT metric, round(current, 4) AS current, round(previous, 4) AS previous, degraded FROM d",
)
def drift_degradation(spark, sf_dir):
    found = D.degradation(*_period_metrics(spark, sf_dir))
    return found.withColumns({"current": F.round("current", 4), "previous": F.round("previous", 4)})


@query(
    "drift_summary",
    "DR-4 DR-5",
    f"""WITH RECURSIVE {_DEGRADED}, {_GAPS}, {_TAIL} SELECT (SELECT count(*) FROM p WHERE p_value < 0.05) AS drifted_features,
        (SELECT count(*) FROM d WHERE degraded) AS degraded_metrics,
        (SELECT count(*) FROM p WHERE p_value < 0.05) >= 1 OR (SELECT count(*) FROM d WHERE degraded) >= 1 AS retrain_recommended""",
)
def drift_summary(spark, sf_dir):
    return D.monitoring_summary(D.feature_drift(*_periods(spark, sf_dir)), D.degradation(*_period_metrics(spark, sf_dir)))


@query(
    "drift_signal_metrics",
    "DR-6",
    f"""WITH RECURSIVE {_DEGRADED}, {_GAPS}, {_TAIL} SELECT 'monitoring_drift_' || "column" AS metric, CAST(p_value < 0.05 AS INTEGER) AS value FROM p
        UNION ALL SELECT 'monitoring_degraded_' || metric, CAST(degraded AS INTEGER) FROM d""",
)
def drift_signal_metrics(spark, sf_dir):
    return D.signal_metrics(D.feature_drift(*_periods(spark, sf_dir)), D.degradation(*_period_metrics(spark, sf_dir)))
