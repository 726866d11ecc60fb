"""What-if analysis applied to every row of a table at once.

Scenarios and steps come from the request, so they are literals. Results of scenarios and of sensitivity are worked out
as further columns of the row, without an explode before scoring, a join or a shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import values as V
from millrace.operators.distribution import exact_quantiles, most_frequent

# ---------------------------------------------------------------------------
# Defaults, direction and mode words, coordinate column names.
STEPS, AMPLITUDE = 12, 0.05
DOWN_WORDS = ("down", "decrease", "negative", "lower")
ABSOLUTE_MODES, TARGET_MODES = ("absolute", "add", "linear"), ("target", "set")
LATITUDE_NAMES = ("lat", "latitude", "y", "geo_lat", "gps_lat")
LONGITUDE_NAMES = ("lon", "lng", "longitude", "x", "geo_lon", "gps_lon")
# ---------------------------------------------------------------------------

# Adds one column of predictions per named point, a point being the features' values.
Scorer = Callable[[DataFrame, Mapping[str, Mapping[str, Column]]], DataFrame]


@dataclass(frozen=True)
class Scenario:
    name: str
    overrides: Mapping[str, Any] = field(default_factory=dict)
    steps: int = STEPS
    amplitude: float = AMPLITUDE
    trend: str = "up"
    deltas: Mapping[str, Any] = field(default_factory=dict)
    features: Sequence[str] = ()


def _check(names: Sequence[str], columns: Sequence[str], where: str) -> None:
    unknown = sorted(set(names) - set(columns))
    if unknown:
        raise ValueError(f"Unknown feature(s) in {where}: {', '.join(unknown)}. Available: {', '.join(columns[:12])}")


def normalise_scenarios(payload: Mapping[str, Any], columns: Sequence[str], max_scenarios: int | None = None, max_steps: int | None = None) -> list[Scenario]:
    """Scenarios of a request with defaults filled in; unknown features are an error."""
    raw = payload.get("scenarios")
    if isinstance(raw, Mapping):
        raw = [{"name": k, "overrides": v} for k, v in raw.items()]
    items = [r for r in raw or [] if isinstance(r, Mapping)][:max_scenarios]
    if not items:
        items = [{"name": payload.get("scenarioName") or payload.get("name") or "Scenario", "overrides": payload.get("scenario") or {}}]

    def number(value: Any, default: float) -> float:
        try:
            return float(value)
        except (TypeError, ValueError):
            return default

    out = []
    for i, item in enumerate(items, 1):
        plan = {**(payload.get("stepPlan") or {}), **(item.get("stepPlan") or {})}
        found = Scenario(
            name=str(item.get("name") or item.get("label") or f"Scenario {i}"), overrides=dict(item.get("overrides") or {}),
            steps=min(max(1, int(number(item.get("steps", payload.get("steps", STEPS)), STEPS))), max_steps or sys.maxsize),
            amplitude=number(item.get("amplitude", payload.get("amplitude", AMPLITUDE)), AMPLITUDE),
            trend=str(item.get("trend", payload.get("trend", "up")) or "up").strip().lower(),
            deltas=dict(plan.get("deltas") or {}), features=tuple(plan.get("features") or ()),
        )
        for names, where in ((found.overrides, f"scenario {i}"), (found.deltas, f"scenario {i} deltas"), (found.features, f"scenario {i} features")):
            _check(list(names), columns, where)
        out.append(found)
    return out


def baseline(df: DataFrame, columns: Sequence[str], source: str = "last", order: Sequence[str] = ()) -> DataFrame:
    """One row: first or last row in ``order``, or the mean or median of numeric columns and the mode of others."""
    kind = str(source or "last").strip().lower()
    if kind not in ("first", "head", "mean", "average", "median"):
        kind = "last"
    picked = F.min_by if kind in ("first", "head") else F.max_by
    key = F.struct(*order)
    row = df.agg(picked(F.struct(*columns), key).alias("r")).select("r.*")
    if kind in ("first", "head", "last"):
        return row
    types = {c: df.schema[c].dataType for c in columns}
    numbers = [c for c in columns if V.is_numeric(types[c])]
    new: dict[str, Column] = {}
    if kind == "median" and numbers:
        table = exact_quantiles(df, numbers, [0.5])
        new = {c: table.where(F.col("column") == c).select("value").scalar() for c in numbers}
    elif numbers:
        means = df.agg(F.struct(*[F.avg(V.as_double(F.col(c), types[c])).alias(c) for c in numbers]).alias("s")).scalar()
        new = {c: means[c] for c in numbers}
    for c in columns:
        if c not in numbers:
            new[c] = F.coalesce(most_frequent(df.select(c), c).select("value").scalar(), F.col(c))
    return row.withColumns(new)


def override(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    """Named features set to given values; an unknown name is an error before any job."""
    _check(list(values), df.columns, "overrides")
    return df.withColumns({c: F.lit(v).cast(df.schema[c].dataType) for c, v in values.items()})


def _moved(x: Column, scenario: Scenario, feature: str, fraction: Column) -> Column:
    value, mode, trend = scenario.amplitude, "relative", scenario.trend
    if feature in scenario.deltas:
        delta = scenario.deltas[feature]
        if isinstance(delta, Mapping):
            value, mode, trend = float(delta.get("value", value)), str(delta.get("mode") or mode).lower(), str(delta.get("trend") or trend).lower()
        else:
            value = float(delta)
    elif scenario.features and feature not in scenario.features:
        return x
    way = -1.0 if trend in DOWN_WORDS else 1.0
    if mode in ABSOLUTE_MODES:
        return x + F.lit(way * value) * fraction
    if mode in TARGET_MODES:
        return x + (F.lit(value) - x) * fraction
    return x * (1 + F.lit(way * value) * fraction)


def _at(df: DataFrame, feature: str, scenario: Scenario, fraction: Column) -> Column:
    """A feature of the row after a fraction of the scenario's steps."""
    dtype = df.schema[feature].dataType
    own = feature in scenario.overrides
    if not V.is_numeric(dtype):
        return F.lit(scenario.overrides[feature]).cast(dtype) if own else F.col(feature)
    start = V.as_double(F.lit(scenario.overrides[feature]), None) if own else V.as_double(F.col(feature), dtype)
    return _moved(start, scenario, feature, fraction)


def step_grid(df: DataFrame, features: Sequence[str], scenarios: Sequence[Scenario]) -> DataFrame:
    """Every row × scenario × step with the features moved along the plan. Text stays as it is."""
    plans = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s.name).alias("name"), F.lit(s.steps).alias("steps")) for i, s in enumerate(scenarios)])
    rows = df.select("*", F.explode(plans).alias("_s")).select("*", F.explode(F.sequence(F.lit(1), F.col("_s.steps"))).alias("step"))
    fraction = F.col("step") / F.col("_s.steps")

    def pick(values: Sequence[Column]) -> Column:
        out = values[-1]
        for i in reversed(range(len(values) - 1)):
            out = F.when(F.col("_s.i") == i, values[i]).otherwise(out)
        return out

    new = {c: pick([_at(df, c, s, fraction) for s in scenarios]) for c in features}
    return rows.withColumns(new).withColumn("scenario", F.col("_s.name")).drop("_s")


def linear_scorer(weights: Mapping[str, float], intercept: float = 0.0) -> Scorer:
    """Scores as one expression per point."""
    def score(df: DataFrame, points: Mapping[str, Mapping[str, Column]]) -> DataFrame:
        return df.withColumns({
            name: reduce(lambda acc, item: acc + at[item[0]] * F.lit(float(item[1])), weights.items(), F.lit(float(intercept))) for name, at in points.items()
        })

    return score


def model_scorer(model: Any, inputs: Sequence[str]) -> Scorer:
    """Predictions of a fitted Spark ML model over numeric ``inputs``, one further column per point in the same pass.

    A point with a missing input gets NULL.
    """
    def score(df: DataFrame, points: Mapping[str, Mapping[str, Column]]) -> DataFrame:
        out, keep = df, list(df.columns)
        for name, at in points.items():
            cells = [at[c].cast("double") for c in inputs]
            whole = reduce(lambda a, b: a & b, [c.isNotNull() for c in cells])
            vector = array_to_vector(F.transform(F.array(*cells), lambda x: F.coalesce(x, F.lit(0.0))))
            one = model.copy({model.getParam("featuresCol"): "_v", model.getParam("predictionCol"): "_p"})
            scored = one.transform(out.withColumns({"_v": vector, "_whole": whole}))
            out = scored.select(*keep, F.when(F.col("_whole"), F.col("_p")).alias(name))
            keep.append(name)
        return out

    return score


def scenario_results(df: DataFrame, features: Sequence[str], scenarios: Sequence[Scenario], score: Scorer, key: Sequence[str]) -> DataFrame:
    """(key, scenario, first_prediction, final_prediction, delta) of every row and scenario.

    Both ends of a scenario are columns of the row, so nothing is exploded before scoring and nothing is shuffled.
    """
    points = {
        f"_{end}{i}": {c: _at(df, c, s, F.lit(step) / F.lit(s.steps)) for c in features}
        for i, s in enumerate(scenarios) for end, step in (("first", 1), ("final", s.steps))
    }
    ends = F.array(*[
        F.struct(F.lit(s.name).alias("scenario"), F.col(f"_first{i}").alias("first_prediction"), F.col(f"_final{i}").alias("final_prediction"))
        for i, s in enumerate(scenarios)
    ])
    rows = score(df.select(*dict.fromkeys([*key, *features])), points).select(*key, F.explode(ends).alias("e")).select(*key, "e.*")
    return rows.withColumn("delta", F.round(F.col("final_prediction") - F.col("first_prediction"), 6))


def changed_features(df: DataFrame, values: Mapping[str, Any], key: Sequence[str]) -> DataFrame:
    """(key, feature, baseline, scenario, delta): features whose value an override changes."""
    _check(list(values), df.columns, "overrides")
    entries = []
    for c, v in values.items():
        dtype = df.schema[c].dataType
        new = F.lit(v).cast(dtype)
        numeric = V.is_numeric(dtype)
        old6, new6 = (F.round(V.as_double(F.col(c), dtype), 6), F.round(V.as_double(new, dtype), 6)) if numeric else (F.col(c), new)
        entries.append(F.when(~old6.eqNullSafe(new6), F.struct(
            F.lit(c).alias("feature"), old6.cast("string").alias("baseline"), new6.cast("string").alias("scenario"),
            (F.round(new6 - old6, 6) if numeric else F.lit(None).cast("double")).alias("delta"),
        )))
    return df.select(*key, F.explode(F.array_compact(F.array(*entries))).alias("e")).select(*key, "e.*")


def applied_drift(df: DataFrame, features: Sequence[str], scenarios: Sequence[Scenario], key: Sequence[str]) -> DataFrame:
    """(key, scenario, feature, drift): absolute move of the numeric features at the last step, worked out in the row."""
    chosen = [c for c in features if V.is_numeric(df.schema[c].dataType)]
    moves = F.array(*[
        F.struct(F.lit(s.name).alias("scenario"), F.lit(c).alias("feature"),
                 F.round(F.abs(_at(df, c, s, F.lit(1.0)) - V.as_double(F.col(c), df.schema[c].dataType)), 6).alias("drift"))
        for s in scenarios for c in chosen
    ])
    return df.select(*key, F.explode(moves).alias("m")).select(*key, "m.*")


def sensitivity(df: DataFrame, features: Sequence[str], score: Scorer, key: Sequence[str], amplitude: float = AMPLITUDE) -> DataFrame:
    """(key, rank, feature, lower, upper, impact, absolute_impact), largest impact first per row.

    Each numeric feature is scaled by 1 - a and 1 + a while the others stay; both predictions are columns of the row.
    Features without both predictions are left out.
    """
    chosen = [c for c in features if V.is_numeric(df.schema[c].dataType)]
    size = abs(amplitude)
    value = {c: V.as_double(F.col(c), df.schema[c].dataType) if c in chosen else F.col(c) for c in features}
    points = {
        f"_{side}{i}": {**value, c: value[c] * F.lit(factor)}
        for i, c in enumerate(chosen) for side, factor in (("lower", 1.0 - size), ("upper", 1.0 + size))
    }
    impact = lambda i: F.round(F.col(f"_upper{i}") - F.col(f"_lower{i}"), 6)
    entries = F.array(*[
        F.when(F.col(f"_lower{i}").isNotNull() & F.col(f"_upper{i}").isNotNull(), F.struct(
            (-F.abs(impact(i))).alias("k"), F.lit(c).alias("feature"), F.col(f"_lower{i}").alias("lower"), F.col(f"_upper{i}").alias("upper"),
            impact(i).alias("impact"), F.abs(impact(i)).alias("absolute_impact"),
        )) for i, c in enumerate(chosen)
    ])
    scored = score(df.select(*dict.fromkeys([*key, *features])), points)
    rows = scored.select(*key, F.posexplode(F.array_sort(F.array_compact(entries))).alias("rank", "e"))
    return rows.select(*key, (F.col("rank") + 1).alias("rank"), *[f"e.{c}" for c in ("feature", "lower", "upper", "impact", "absolute_impact")])


def coordinate_columns(columns: Sequence[str]) -> tuple[str | None, str | None]:
    """(latitude, longitude) columns by name."""
    known = {c.strip().lower(): c for c in columns}
    return next((known[n] for n in LATITUDE_NAMES if n in known), None), next((known[n] for n in LONGITUDE_NAMES if n in known), None)


def geojson_points(df: DataFrame, properties: Sequence[str]) -> DataFrame:
    """GeoJSON point features as JSON text; rows without readable coordinates are left out."""
    lat, lon = coordinate_columns(df.columns)
    if not lat or not lon:
        raise ValueError("No latitude and longitude columns.")
    y, x = (V.as_double(F.col(c), df.schema[c].dataType) for c in (lat, lon))
    point = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties")))
    return df.where(y.isNotNull() & x.isNotNull()).select(*properties, feature.alias("feature"))
