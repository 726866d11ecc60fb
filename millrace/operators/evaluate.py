"""Evaluation metrics as long (metric, value) tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Name parts of metrics that improve when they fall, metrics allowed per task.
LOWER_IS_BETTER = ("loss", "error", "rmse", "mae", "mse", "mape", "latency", "duration")
REGRESSION_METRICS = ("rmse", "mse", "mae", "mape", "r2")
CLASSIFICATION_METRICS = ("accuracy", "precision", "recall", "f1")
OTHER_METRICS = ("fit_duration_sec", "output_rows", "output_columns", "output_mean", "output_std")
DEFAULT_OBJECTIVE = {"regression": "rmse", "classification": "accuracy"}
MAPE_FLOOR = 1e-8


def _long(row: DataFrame) -> DataFrame:
    return row.unpivot([], row.columns, "metric", "value")


def regression_metrics(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """rmse, mse, mae, mape and r2 in one aggregate.

    The total sum of squares comes from the population variance, which Spark merges in centred
    form, so large means do not cancel digits and no second pass is needed.
    """
    y, p = F.col(truth).cast("double"), F.col(prediction).cast("double")
    error = y - p
    sums = df.where(y.isNotNull() & p.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"),
        (F.avg(F.abs(error) / F.greatest(F.abs(y), F.lit(MAPE_FLOOR))) * 100).alias("mape"), F.var_pop(y).alias("spread"),
    )
    flat = F.when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    r2 = F.when(F.col("n") < 2, F.lit(None)).when(F.col("spread") == 0, flat).otherwise(1 - F.col("mse") / F.nullif(F.col("spread"), F.lit(0.0)))
    return _long(sums.select(F.sqrt("mse").alias("rmse"), "mse", "mae", "mape", r2.alias("r2")))


def confusion(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Per label of either side: hits, predicted, actual, precision, recall, f1 (0 where undefined)."""
    hit = F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col("truth").alias("label"), hit.alias("hits"), F.lit(0).cast("bigint").alias("predicted"), F.col("n").alias("actual")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).cast("bigint").alias("hits"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("actual")),
    )
    per = (
        confusion(df, truth, prediction).select(F.explode(sides).alias("s")).select("s.*").groupBy("label")
        .agg(F.sum("hits").alias("hits"), F.sum("predicted").alias("predicted"), F.sum("actual").alias("actual"))
    )

    def share(top: Column, bottom: Column) -> Column:
        return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))

    return per.withColumns({
        "precision": share(F.col("hits"), F.col("predicted")),
        "recall": share(F.col("hits"), F.col("actual")),
        "f1": share(2 * F.col("hits"), F.col("predicted") + F.col("actual")),
    })


def classification_metrics(df: DataFrame, truth: str, prediction: str, average: str = "macro") -> DataFrame:
    """accuracy, precision, recall and f1; averages: macro, micro or weighted."""
    per = class_scores(df, truth, prediction)
    accuracy = (F.sum("hits") / F.sum("actual")).alias("accuracy")
    if average == "micro":
        rest = [(F.sum("hits") / F.sum(side)).alias(name) for name, side in (("precision", "predicted"), ("recall", "actual"), ("f1", "actual"))]
    elif average == "weighted":
        rest = [(F.sum(F.col(name) * F.col("actual")) / F.sum("actual")).alias(name) for name in ("precision", "recall", "f1")]
    elif average == "macro":
        rest = [F.avg(name).alias(name) for name in ("precision", "recall", "f1")]
    else:
        raise ValueError(f"Unknown average: {average}")
    return _long(per.agg(accuracy, *rest))


def evaluate(df: DataFrame, truth: str, prediction: str, task: str, prefix: str = "", average: str = "macro") -> DataFrame:
    """Metrics of the task with a name prefix."""
    if task == "regression":
        table = regression_metrics(df, truth, prediction)
    elif task == "classification":
        table = classification_metrics(df, truth, prediction, average)
    else:
        raise ValueError(f"Unsupported task: {task}")
    return table.select(F.concat(F.lit(prefix), "metric").alias("metric"), "value")


def higher_is_better(metric: Column) -> Column:
    return ~F.lower(metric).rlike("|".join(LOWER_IS_BETTER))


def resolve_metrics(spark: SparkSession, task: str, requested: Sequence[str], objective: str | None = None) -> DataFrame:
    """(metric, accepted) of the requested names and the objective that will be used."""
    allowed = {
        "regression": REGRESSION_METRICS + ("fit_duration_sec",),
        "classification": CLASSIFICATION_METRICS + ("fit_duration_sec",),
    }.get(task, OTHER_METRICS)
    default = DEFAULT_OBJECTIVE.get(task, "fit_duration_sec")
    wanted = str(objective or default).strip().lower()
    names = [str(m).strip().lower() for m in requested if str(m).strip()]
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(n in allowed).alias("accepted")) for n in names])
    return spark.range(1).select(F.explode(rows).alias("r")).select(
        "r.metric", "r.accepted", F.lit(wanted if wanted in allowed else default).alias("objective")
    )


def numeric_metrics(df: DataFrame, entity: str, metrics: str) -> DataFrame:
    """map<string,string> of metrics as (entity, metric, value) rows, non-numeric entries dropped."""
    from millrace.functions.values import as_double

    rows = df.select(F.col(entity).alias("entity"), F.explode(metrics).alias("metric", "raw"))
    return rows.select("entity", "metric", as_double(F.col("raw")).alias("value")).where(F.col("value").isNotNull())


def output_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Shape, mean and population deviation over all output cells."""
    cells = F.explode(F.array(*[F.col(c).cast("double") for c in columns]))
    return df.select(cells.alias("x")).agg(
        (F.count(F.lit(1)) / len(columns)).cast("bigint").alias("output_rows"), F.lit(len(columns)).alias("output_columns"),
        F.avg("x").alias("output_mean"), F.stddev_pop("x").alias("output_std"),
    )
