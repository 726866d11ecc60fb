"""Model fit, scoring and parameter search with Spark ML.

Training frames hold a vector column ``features`` and a numeric column ``label``.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.operators import drift as D
from millrace.operators.evaluate import evaluate, higher_is_better
from millrace.operators.ordered import running_extreme
from millrace.session import durable

# ---------------------------------------------------------------------------
# Default search spaces and bounds.
TRIALS = 15
THRESHOLD = 0.5
SEARCH_SPACES: dict[str, dict[str, dict[str, Any]]] = {
    "classification": {
        "estimator_class": {"type": "categorical", "choices": ["LogisticRegression", "RandomForestClassifier", "GradientBoostingClassifier"]},
        "max_depth": {"type": "int", "low": 2, "high": 12, "step": 1},
        "n_estimators": {"type": "int", "low": 50, "high": 200, "step": 25},
    },
    "regression": {
        "estimator_class": {"type": "categorical", "choices": ["LinearRegression", "RandomForestRegressor", "GradientBoostingRegressor", "Ridge"]},
        "max_depth": {"type": "int", "low": 2, "high": 12, "step": 1},
        "n_estimators": {"type": "int", "low": 50, "high": 200, "step": 25},
    },
    "network": {
        "hidden_dim": {"type": "int", "low": 16, "high": 128, "step": 16},
        "hidden_layers": {"type": "int", "low": 1, "high": 4, "step": 1},
        "dropout": {"type": "float", "low": 0.0, "high": 0.4, "step": 0.1},
        "learning_rate": {"type": "float", "low": 0.0005, "high": 0.01, "log": True},
        "batch_size": {"type": "categorical", "choices": [16, 32, 64]},
    },
}
# ---------------------------------------------------------------------------


@dataclass
class Fitted:
    model: Any
    kind: str
    task: str
    fit_duration_sec: float
    details: dict[str, Any] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


def _size(params: Mapping[str, Any], name: str, default: int) -> int:
    value = params.get(name)
    return int(default if value is None else value)


def _estimator(kind: str, params: Mapping[str, Any], classes: int = 2) -> Any:
    depth, trees = _size(params, "max_depth", 5), _size(params, "n_estimators", 20)
    penalty, seed = float(params.get("reg_param", 0.0)), _size(params, "seed", 42)
    table: dict[str, Callable[[], Any]] = {
        "LinearRegression": lambda: LinearRegression(regParam=penalty),
        "Ridge": lambda: LinearRegression(regParam=penalty or 1.0, elasticNetParam=0.0),
        "RandomForestRegressor": lambda: RandomForestRegressor(maxDepth=depth, numTrees=trees, seed=seed),
        "GradientBoostingRegressor": lambda: GBTRegressor(maxDepth=depth, maxIter=trees, seed=seed),
        "LogisticRegression": lambda: LogisticRegression(maxIter=_size(params, "max_iter", 1000), regParam=penalty),
        "RandomForestClassifier": lambda: RandomForestClassifier(maxDepth=depth, numTrees=trees, seed=seed),
        "GradientBoostingClassifier": lambda: (
            GBTClassifier(maxDepth=depth, maxIter=trees, seed=seed) if classes <= 2
            else OneVsRest(classifier=GBTClassifier(maxDepth=depth, maxIter=trees, seed=seed))
        ),
    }
    if kind not in table:
        raise ValueError(f"Unknown estimator: {kind}")
    return table[kind]()


def _fit_key(kind: str, params: Mapping[str, Any]) -> Any:
    """Equal for parameters that make the same estimator; without an estimator, for equal parameters."""
    try:
        estimator = _estimator(kind, params)
    except Exception:  # the fit itself will say so
        return kind, repr(sorted(params.items()))
    return type(estimator).__name__, repr(sorted((p.name, repr(v)) for p, v in estimator.extractParamMap().items()))


def _timed(estimator: Any, train: DataFrame, kind: str, task: str, **details: Any) -> Fitted:
    start = time.monotonic()
    model = estimator.fit(train)
    return Fitted(model, kind, task, time.monotonic() - start, details)


def merged_rows(train: DataFrame, same: Sequence[str]) -> DataFrame:
    """(features, label, weight): rows equal in ``same`` as one, with their mean label and their number as weight.

    A fit by squared error finds the same trees on them as on the rows, since the spread inside a merged row is the same for
    every split; with ``label`` in ``same`` this holds for any loss. A missing label leaves the merged one missing.
    """
    label = F.when(F.count("label") == F.count(F.lit(1)), F.avg(F.col("label").cast("double"))).alias("_mean")
    merged = train.select("features", "label").groupBy(*same).agg(label, F.count(F.lit(1)).cast("double").alias("weight"))
    return merged.select("features", F.col("_mean").alias("label"), "weight")


def fit_regressor(train: DataFrame, kind: str = "LinearRegression", **params: Any) -> Fitted:
    """Boosting passes over its rows once per level of every tree, so it gets them merged by equal features."""
    estimator = _estimator(kind, params)
    if kind == "GradientBoostingRegressor":
        return _timed(estimator.setWeightCol("weight"), durable(merged_rows(train, ["features"])), kind, "regression")
    return _timed(estimator, train, kind, "regression")


def fit_classifier(train: DataFrame, kind: str = "LogisticRegression", classes: int = 2, **params: Any) -> Fitted:
    """Boosting gets rows merged by equal features and label."""
    estimator = _estimator(kind, params, classes)
    if kind == "GradientBoostingClassifier":
        return _timed(estimator.setWeightCol("weight"), durable(merged_rows(train, ["features", "label"])), kind, "classification")
    return _timed(estimator, train, kind, "classification")


def fit_unsupervised(train: DataFrame, family: str, **params: Any) -> Fitted:
    """clustering, scaling, projection or outlier (distance to the nearest centre above a quantile)."""
    if family == "scaling":
        return _timed(StandardScaler(inputCol="features", outputCol="output", withMean=True), train, "StandardScaler", family)
    if family == "projection":
        return _timed(PCA(k=_size(params, "components", 2), inputCol="features", outputCol="output"), train, "PCA", family)
    if family not in ("clustering", "outlier"):
        raise ValueError(f"Unknown family: {family}")
    found = _timed(KMeans(k=_size(params, "clusters", 2), seed=_size(params, "seed", 42)), train, "KMeans", family)
    if family == "outlier":
        share = float(params.get("share", 0.99))
        scored = centre_distance(found, found.transform(train))
        found.details["limit"] = scored.agg(F.percentile_approx("distance", share, 10_000).alias("q")).first()["q"]
    return found


def centre_distance(found: Fitted, scored: DataFrame) -> DataFrame:
    """Adds the distance to the assigned cluster centre, computed from the literal centres."""
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in found.model.clusterCenters()])
    own = F.get(centres, F.col("prediction"))
    squares = F.zip_with(vector_to_array("features"), own, lambda a, b: (a - b) * (a - b))
    return scored.withColumn("distance", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)))


def flag_outliers(found: Fitted, df: DataFrame) -> DataFrame:
    """Adds ``distance`` and ``is_outlier``."""
    return centre_distance(found, found.transform(df)).withColumn("is_outlier", F.col("distance") > found.details["limit"])


def fit_network(train: DataFrame, layers: Sequence[int], epochs: int = 50, seed: int = 42, step: float = 0.03) -> Fitted:
    """Feed-forward classifier; ``details['loss']`` is the loss per epoch."""
    estimator = MultilayerPerceptronClassifier(layers=list(layers), maxIter=epochs, seed=seed, stepSize=step)
    found = _timed(estimator, train, "MultilayerPerceptron", "classification")
    found.details["loss"] = list(found.model.summary().objectiveHistory)
    return found


def loss_history(spark: SparkSession, found: Fitted) -> DataFrame:
    """(epoch, loss) of an iterative fit."""
    losses = found.details.get("loss") or list(found.model.summary.objectiveHistory)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(losses)], "epoch int, loss double")


def fit_outputs(train: DataFrame, targets: Sequence[str], kind: str, task: str, **params: Any) -> dict[str, Fitted]:
    """One model per target column."""
    fit = fit_regressor if task == "regression" else fit_classifier
    return {t: fit(train.withColumn("label", F.col(t).cast("double")), kind, **params) for t in targets}


def predict_outputs(found: Mapping[str, Fitted], df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Predictions of every target side by side, all in one pass over the rows."""
    out = df
    for target, one in found.items():
        out = one.transform(out).withColumnRenamed("prediction", f"{target}_prediction").drop("rawPrediction", "probability")
    return out.select(*keep, *[f"{t}_prediction" for t in found])


def predict(found: Fitted, df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``prediction``; a two-class model compares the second probability with the threshold."""
    out = found.transform(df)
    if found.task != "classification" or threshold == THRESHOLD or "probability" not in out.columns:
        return out
    chance = vector_to_array("probability")
    return out.withColumn("prediction", F.when(F.size(chance) == 2, (chance[1] >= threshold).cast("double")).otherwise(F.col("prediction")))


def class_probabilities(scored: DataFrame, key: str, labels: DataFrame, top: int | None = None) -> DataFrame:
    """(key, place, label, probability): all or the likeliest classes with their original labels.

    Sorting happens inside each row. ``labels`` (value, code) has one row per class and is sent to the rows, which are many
    for each class and stay where they are.
    """
    pairs = F.transform(vector_to_array("probability"), lambda p, i: F.struct((-p).alias("k"), i.alias("code"), p.alias("probability")))
    ranked = F.slice(F.array_sort(pairs), 1, top) if top else F.array_sort(pairs)
    rows = scored.select(key, F.posexplode(ranked).alias("place", "p")).select(key, (F.col("place") + 1).alias("place"), F.col("p.code").alias("code"), "p.probability")
    return rows.join(F.broadcast(labels.select(F.col("code").cast("int").alias("code"), F.col("value").alias("label"))), "code").drop("code")


# --- parameter search -------------------------------------------------------


def draw(trial: Column, name: str, config: Mapping[str, Any], seed: int = 42) -> Column:
    """One parameter drawn from a hash of the trial number, the same on every run."""
    u = F.pmod(F.xxhash64(trial, F.lit(name), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    kind = str(config.get("type", "categorical")).lower()
    if kind == "int":
        low, high, step = int(config.get("low", 1)), int(config.get("high", 10)), int(config.get("step", 1))
        return (F.lit(low) + F.lit(step) * F.floor(u * ((high - low) // step + 1))).cast("int")
    if kind == "float":
        low, high = float(config.get("low", 0.001)), float(config.get("high", 1.0))
        if config.get("log"):
            return F.exp(F.log(F.lit(low)) + u * (F.log(F.lit(high)) - F.log(F.lit(low))))
        if config.get("step"):
            step = float(config["step"])
            return F.round(F.lit(low) + F.lit(step) * F.floor(u * (int(round((high - low) / step)) + 1)), 10)
        return F.lit(low) + u * (high - low)
    choices = F.array(*[F.lit(c) for c in config.get("choices", [])])
    return F.get(choices, F.floor(u * len(config["choices"])).cast("int"))


def draw_trials(trials: DataFrame, number: str, space: Mapping[str, Mapping[str, Any]], seed: int = 42) -> DataFrame:
    """Adds one column per parameter to a table of trial numbers."""
    return trials.withColumns({name: draw(F.col(number), name, config, seed) for name, config in space.items()})


def share_of(df: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """About that share of the rows, drawn by a hash of their cells: larger shares contain smaller ones, on any partitioning."""
    cells = [vector_to_array(c) if c == "features" else F.col(f"`{c}`") for c in df.columns]
    return df.where(F.pmod(F.xxhash64(*cells, F.lit(seed)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def run_search(
    train: DataFrame, test: DataFrame, task: str, trials: int = TRIALS, objective: str | None = None,
    space: Mapping[str, Mapping[str, Any]] | None = None, seed: int = 42, parallelism: int = 2, shares: Sequence[float] = (),
) -> DataFrame:
    """(number, estimator_class, params, metric, direction, value, state, error, is_best, rounds): random search.

    The trial list is short and known; each fit and each evaluation is a distributed job. A trial
    that fails keeps its message and the others go on. If the evaluation lacks the objective, the value is
    the best metric there is by the objective's direction. Trials that differ only in parameters their estimator
    does not have (trees of a linear fit) are one fit with one value.

    With ``shares`` (rising, below 1) trials are first fitted on these shares of the training rows and of their trees. After
    each such round the worse half of those still in the race is PRUNED with its last value; of equal ones the higher
    numbers go. Only trials that went through all rounds are fitted whole, are COMPLETE and can be the best.
    """
    spark = train.sparkSession
    chosen = space or SEARCH_SPACES[task]
    metric = objective or ("rmse" if task == "regression" else "accuracy")
    plans = [r.asDict() for r in draw_trials(spark.range(trials).withColumnRenamed("id", "number"), "number", chosen, seed).collect()]
    fit = fit_regressor if task == "regression" else fit_classifier

    upward = spark.range(1).select(higher_is_better(F.lit(metric)).alias("up")).first()["up"]
    pick = max if upward else min

    def kind_of(plan: Mapping[str, Any]) -> str:
        return plan.get("estimator_class") or ("LinearRegression" if task == "regression" else "LogisticRegression")

    def params_of(plan: Mapping[str, Any], share: float) -> dict[str, Any]:
        params = {k: v for k, v in plan.items() if k not in ("number", "estimator_class")}
        if share < 1 and params.get("n_estimators"):
            params["n_estimators"] = math.ceil(params["n_estimators"] * share)
        return params

    def one(plan: Mapping[str, Any], rows: DataFrame, share: float) -> tuple[float | None, str | None]:
        try:
            scored = fit(rows, kind_of(plan), **params_of(plan, share)).transform(test)
            values = {r["metric"]: r["value"] for r in evaluate(scored, "label", "prediction", task).collect()}
        except Exception as error:  # a failed trial is a result of the search
            return None, f"{type(error).__name__}: {error}"
        known = [v for v in values.values() if v is not None]
        return values.get(metric, pick(known) if known else None), None

    ended: dict[int, tuple[float | None, str, str | None, int]] = {}
    running = plans
    with ThreadPoolExecutor(parallelism) as pool:
        for number, share in enumerate([*shares, 1.0], 1):
            rows = train if share >= 1 else durable(share_of(train, share, seed))
            alike: dict[Any, list[dict[str, Any]]] = {}
            for p in running:
                alike.setdefault(_fit_key(kind_of(p), params_of(p, share)), []).append(p)
            scores = pool.map(lambda same: one(same[0], rows, share), alike.values())
            results = {p["number"]: score for same, score in zip(alike.values(), scores) for p in same}
            ended.update({n: (None, "FAIL", error, number) for n, (_, error) in results.items() if error})
            alive = [p for p in running if not results[p["number"]][1]]
            if share >= 1:
                ended.update({p["number"]: (results[p["number"]][0], "COMPLETE", None, number) for p in alive})
                break
            worst = -math.inf if upward else math.inf
            place = lambda p: ((-1 if upward else 1) * (worst if results[p["number"]][0] is None else results[p["number"]][0]), p["number"])
            ranked = sorted(alive, key=place)
            running = ranked[: -(-len(ranked) // 2)]
            ended.update({p["number"]: (results[p["number"]][0], "PRUNED", None, number) for p in ranked[len(running):]})
    complete = {n: v for n, (v, state, _, _) in ended.items() if state == "COMPLETE" and v is not None}
    best = pick(complete.values(), default=None)
    winner = min((n for n, v in complete.items() if v == best), default=None)
    texts = {p["number"]: {k: str(v) for k, v in p.items() if k not in ("number", "estimator_class")} for p in plans}
    rows = [
        (p["number"], kind_of(p), texts[p["number"]], metric, "maximize" if upward else "minimize", *ended[p["number"]][:3], p["number"] == winner, ended[p["number"]][3])
        for p in plans
    ]
    return spark.createDataFrame(
        rows,
        "number bigint, estimator_class string, params map<string,string>, metric string, direction string, value double, state string, "
        "error string, is_best boolean, rounds int",
    )


def study_summary(trials: DataFrame, minimise: bool = True, study: str = "study_name") -> DataFrame:
    """Per study: trials by state, best value and its parameters among completed trials."""
    done = F.col("state") == "COMPLETE"
    place = F.struct((F.col("value") if minimise else -F.col("value")).alias("v"), F.col("number"))
    return trials.groupBy(study).agg(
        F.count(F.lit(1)).alias("n_trials"), F.count_if(done).alias("completed_trials"), F.count_if(F.col("state") == "PRUNED").alias("pruned_trials"),
        F.count_if(F.col("state") == "FAIL").alias("failed_trials"), F.min_by("value", F.when(done & F.col("value").isNotNull(), place)).alias("best_value"),
        F.min_by("params", F.when(done & F.col("value").isNotNull(), place)).alias("best_params"),
    ).withColumn("has_best_trial", F.col("best_value").isNotNull())


def best_so_far(trials: DataFrame, minimise: bool = True, study: str = "study_name") -> DataFrame:
    """Adds the best completed value up to each trial, spread over ranges of the trial number."""
    value = F.when(F.col("state") == "COMPLETE", F.col("value"))
    return running_extreme(trials, [study], ["number"], value, "best_so_far", largest=not minimise)


# --- monitoring -------------------------------------------------------------


@dataclass
class Snapshot:
    metrics: DataFrame
    drift: DataFrame
    prediction: DataFrame
    degradation: DataFrame
    summary: DataFrame


def monitoring_snapshot(
    found: Fitted, reference: DataFrame, current: DataFrame, features: Sequence[str], previous_metrics: DataFrame | None = None
) -> Snapshot:
    """Score both tables and compare: metrics, feature and prediction drift, degradation, summary.

    ``features`` are plain numeric columns kept beside the vector.
    """
    wanted = list(dict.fromkeys([*features, "label", "prediction"]))
    old, new = (durable(found.transform(df).select(*wanted)) for df in (reference, current))  # each table is scored once
    before = previous_metrics if previous_metrics is not None else evaluate(old, "label", "prediction", found.task)
    now = evaluate(new, "label", "prediction", found.task)
    moved = D.feature_drift(old.select(*features), new.select(*features))
    worse = D.degradation(now, before)
    shifted = durable(D.prediction_drift(old, new))
    summary = D.monitoring_summary(moved, worse).withColumns({
        "prediction_drifted": shifted.select("drifted").scalar(), "prediction_p_value": shifted.select("p_value").scalar(),
        "evaluated_at": F.current_timestamp(),
    })
    return Snapshot(now, moved, shifted, worse, summary)


def monitor_and_retrain(
    found: Fitted, reference: DataFrame, current: DataFrame, features: Sequence[str], **params: Any
) -> tuple[Fitted, DataFrame]:
    """Keep a stable model or refit it on the current data; returns the model and one outcome row."""
    shot = monitoring_snapshot(found, reference, current, features)
    facts = shot.summary.first()
    outcome, model = "stable", found
    if facts["retrain_recommended"]:
        outcome, model = "retrained", (fit_regressor if found.task == "regression" else fit_classifier)(current, found.kind, **params)
    scores = {r["metric"]: r["value"] for r in evaluate(model.transform(current), "label", "prediction", model.task).collect()}
    row = [(outcome, int(facts["drifted_features"]), int(facts["degraded_metrics"]), bool(facts["prediction_drifted"]), float(model.fit_duration_sec), scores)]
    schema = "outcome string, drifted_features bigint, degraded_metrics bigint, prediction_drifted boolean, fit_duration_sec double, metrics map<string,double>"
    return model, current.sparkSession.createDataFrame(row, schema)
