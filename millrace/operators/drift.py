"""Drift, degradation and the retraining rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from millrace.functions.values import is_numeric
from millrace.operators.distribution import EXACT_UPTO, two_sample_distance, two_sample_tail
from millrace.operators.evaluate import higher_is_better

# Significance, tolerance and the number of signals that trigger retraining.
DRIFT_P = 0.05
TOLERANCE = 0.05
MIN_DRIFTED, MIN_DEGRADED = 1, 1


def feature_drift(
    reference: DataFrame, current: DataFrame, columns: Sequence[str] | None = None, threshold: float = DRIFT_P,
    by: Sequence[str] = (), exact_upto: int = EXACT_UPTO,
) -> DataFrame:
    """(by..., column, n_reference, n_current, distance, p_value, drifted) for shared numeric columns.

    The p-value is exact while both sides have at most ``exact_upto`` values; beyond, it is asymptotic with a
    correction for the size. With ``by`` every group of rows is compared on its own.
    """
    right = {f.name: f.dataType for f in current.schema.fields}
    shared = [f.name for f in reference.schema.fields if is_numeric(f.dataType) and is_numeric(right.get(f.name)) and f.name not in by]
    chosen = [c for c in shared if columns is None or c in columns]
    if not chosen:
        raise ValueError("No shared numeric column to compare.")
    gaps = two_sample_distance(reference, current, chosen, by)
    tail = two_sample_tail(F.col("distance"), F.col("n_reference"), F.col("n_current"), exact_upto)
    return gaps.withColumn("p_value", tail).withColumn("drifted", F.col("p_value") < threshold)


def prediction_drift(reference: DataFrame, current: DataFrame, prediction: str = "prediction", threshold: float = DRIFT_P) -> DataFrame:
    """The same test on one prediction column; an empty side is an error when the row is read."""
    row = feature_drift(reference.select(prediction), current.select(prediction), [prediction], threshold)
    guarded = row.agg(F.first("distance").alias("distance"), F.first("p_value").alias("p_value"), F.first("drifted").alias("drifted"))
    message = F.lit("Predictions must not be empty.")
    return guarded.select(
        F.when(F.col("distance").isNull(), F.raise_error(message).cast("double")).otherwise(F.col("distance")).alias("distance"), "p_value", "drifted"
    )


def degradation(current: DataFrame, previous: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(metric, previous, current, degraded) for metrics known on both sides."""
    joined = current.select("metric", F.col("value").alias("current")).join(
        previous.select("metric", F.col("value").alias("previous")), "metric"
    )
    worse = F.when(higher_is_better(F.col("metric")), F.col("current") < F.col("previous") * (1 - tolerance)).otherwise(
        F.col("current") > F.col("previous") * (1 + tolerance)
    )
    return joined.withColumn("degraded", worse)


def monitoring_summary(drift: DataFrame, degraded: DataFrame, min_drifted: int = MIN_DRIFTED, min_degraded: int = MIN_DEGRADED) -> DataFrame:
    """One row: counts of drifted features and degraded metrics, and whether to retrain."""
    signals = drift.select(F.col("drifted").cast("int").alias("d"), F.lit(0).alias("g")).unionAll(
        degraded.select(F.lit(0).alias("d"), F.col("degraded").cast("int").alias("g"))
    )
    counted = signals.agg(
        F.coalesce(F.sum("d"), F.lit(0)).alias("drifted_features"), F.coalesce(F.sum("g"), F.lit(0)).alias("degraded_metrics")
    )
    retrain = (F.col("drifted_features") >= min_drifted) | (F.col("degraded_metrics") >= min_degraded)
    return counted.withColumn("retrain_recommended", retrain)


def signal_metrics(drift: DataFrame, degraded: DataFrame, prefix: str = "monitoring_") -> DataFrame:
    """Signals as numeric (metric, value) rows."""
    return drift.select(F.concat(F.lit(prefix + "drift_"), "column").alias("metric"), F.col("drifted").cast("int").alias("value")).unionAll(
        degraded.select(F.concat(F.lit(prefix + "degraded_"), "metric").alias("metric"), F.col("degraded").cast("int").alias("value"))
    )
