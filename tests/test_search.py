"""Random search: rounds on growing shares stop the worse half."""

from __future__ import annotations

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from millrace.operators import models as M

SPACE = {"estimator_class": {"type": "categorical", "choices": ["LinearRegression", "Ridge"]}, "reg_param": {"type": "float", "low": 0.0, "high": 50.0}}


@pytest.fixture(scope="module")
def sides(spark):
    rows = spark.range(900).select("id", (F.col("id") % 37).cast("double").alias("x"), (F.col("id") % 11).cast("double").alias("y"))
    ready = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(rows.withColumn("label", 2 * F.col("x") - F.col("y")))
    return ready.where("id % 5 > 0").select("features", "label").repartition(3), ready.where("id % 5 = 0").select("features", "label")


def test_worse_half_is_pruned(spark, sides):
    got = M.run_search(*sides, "regression", trials=9, space=SPACE, shares=(0.2, 0.5)).toPandas()
    assert got.state.value_counts().to_dict() == {"PRUNED": 6, "COMPLETE": 3} and sorted(got.rounds) == [1] * 4 + [2] * 2 + [3] * 3
    whole = M.run_search(*sides, "regression", trials=9, space=SPACE).toPandas()
    assert set(whole.state) == {"COMPLETE"} and set(whole.rounds) == {1}
    # The loss rises with the penalty here, so the best trial of all must come through.
    assert got[got.is_best].number.tolist() == whole[whole.is_best].number.tolist()
    study = M.study_summary(spark.createDataFrame(got[["number", "state", "value"]].assign(study_name="s", params="p"))).first()
    assert (study["pruned_trials"], study["completed_trials"]) == (6, 3) and study["best_value"] == got[got.is_best].value.iloc[0]


def test_failed_trials_leave_the_race(sides):
    space = {**SPACE, "estimator_class": {"type": "categorical", "choices": ["LinearRegression", "Nothing"]}}
    got = M.run_search(*sides, "regression", trials=8, space=space, shares=(0.3,)).toPandas()
    bad = got.estimator_class == "Nothing"
    assert 0 < bad.sum() < 8 and (got[bad].state == "FAIL").all() and got[bad].error.str.contains("Unknown estimator").all() and got.is_best.sum() == 1


def test_shares_are_nested_and_stable(sides):
    train, _ = sides
    cells = lambda df: {(tuple(r["features"]), r["label"]) for r in df.collect()}
    small, large = cells(M.share_of(train, 0.2)), cells(M.share_of(train, 0.5))
    assert small < large and small == cells(M.share_of(train.repartition(7), 0.2))


def test_equal_fits_are_made_once(sides, monkeypatch):
    """Trees and depth mean nothing to linear fits: such trials share one fit and keep a row each."""
    fits, plain = [], M.fit_regressor
    monkeypatch.setattr(M, "fit_regressor", lambda rows, kind, **p: (fits.append(kind), plain(rows, kind, **p))[1])
    space = {
        "estimator_class": {"type": "categorical", "choices": ["LinearRegression", "Ridge"]},
        "max_depth": {"type": "int", "low": 2, "high": 12}, "n_estimators": {"type": "int", "low": 50, "high": 200, "step": 25},
    }
    got = M.run_search(*sides, "regression", trials=10, space=space).toPandas()
    assert sorted(fits) == ["LinearRegression", "Ridge"]
    assert len(got) == 10 and (got.state == "COMPLETE").all() and got.groupby("estimator_class").value.nunique().tolist() == [1, 1]


def test_different_fits_are_not_taken_for_equal():
    keys = {M._fit_key("RandomForestRegressor", {"max_depth": d, "n_estimators": n}) for d in (2, 3) for n in (5, 6)}
    keys |= {M._fit_key("Ridge", {"reg_param": r}) for r in (0.5, 2.0)} | {M._fit_key("GradientBoostingRegressor", {"max_depth": 2, "n_estimators": 5})}
    assert len(keys) == 7 and M._fit_key("Nothing", {"a": 1}) == M._fit_key("Nothing", {"a": 1})
