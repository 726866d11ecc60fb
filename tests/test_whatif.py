"""What-if results in the row: no shuffle, and the same numbers for an expression and a fitted model."""

from __future__ import annotations

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from millrace.operators import whatif as W

FEATURES = ["a", "b", "t"]
SCENARIOS = W.normalise_scenarios({"scenarios": [{"name": "up", "steps": 3, "amplitude": 0.3}, {"name": "set", "steps": 2, "overrides": {"a": 4}}]}, FEATURES)


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("w") / "rows")
    spark.range(60).select("id", (F.col("id") + 1.0).alias("a"), (F.col("id") % 7 + 0.5).alias("b"), F.lit("x").alias("t")).write.parquet(path)
    return spark.read.parquet(path)


def _model(rows):
    ready = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows.withColumn("label", 3 * F.col("a") - 2 * F.col("b") + 5))
    return LinearRegression().fit(ready)


def test_model_and_expression_agree(rows):
    model, line = W.model_scorer(_model(rows), ["a", "b"]), W.linear_scorer({"a": 3.0, "b": -2.0}, 5.0)
    for made in (lambda s: W.scenario_results(rows, FEATURES, SCENARIOS, s, ["id"]), lambda s: W.sensitivity(rows, FEATURES, s, ["id"], 0.1)):
        one, two = (made(s).toPandas().sort_values(["id", made(s).columns[1]]).reset_index(drop=True) for s in (model, line))
        assert len(one) == 120 and one.select_dtypes("object").equals(two.select_dtypes("object"))
        assert (one.select_dtypes("number") - two.select_dtypes("number")).abs().max().max() < 1e-5


def test_results_of_one_row(rows):
    got = {r["scenario"]: r for r in W.scenario_results(rows.where("id = 1"), FEATURES, SCENARIOS, W.linear_scorer({"a": 10.0}), ["id"]).collect()}
    assert abs(got["up"]["first_prediction"] - 22.0) < 1e-9 and abs(got["up"]["final_prediction"] - 26.0) < 1e-9
    assert abs(got["set"]["first_prediction"] - 40 * 1.025) < 1e-9 and abs(got["set"]["delta"] - 1.0) < 1e-6
    moved = {(r["scenario"], r["feature"]): r["drift"] for r in W.applied_drift(rows.where("id = 1"), FEATURES, SCENARIOS, ["id"]).collect()}
    assert abs(moved["up", "a"] - 0.6) < 1e-9 and abs(moved["set", "a"] - 2.2) < 1e-9 and set(moved) == {(s, f) for s in ("up", "set") for f in "ab"}


def test_missing_inputs_give_no_prediction(spark, rows):
    some = rows.withColumn("b", F.when(F.col("id") > 0, F.col("b"))).where("id < 2")
    for score in (W.model_scorer(_model(rows), ["a", "b"]), W.linear_scorer({"a": 3.0, "b": -2.0})):
        got = W.scenario_results(some, FEATURES, SCENARIOS, score, ["id"]).collect()
        assert all((r["first_prediction"] is None) == (r["id"] == 0) for r in got) and len(got) == 4
        assert {r["id"] for r in W.sensitivity(some, FEATURES, score, ["id"]).collect()} == {1}
    assert W.scenario_results(rows.limit(0), FEATURES, SCENARIOS, W.linear_scorer({"a": 1.0}), ["id"]).collect() == []


def test_nothing_is_shuffled(rows):
    model, line = W.model_scorer(_model(rows), ["a", "b"]), W.linear_scorer({"a": 3.0})
    frames = [W.applied_drift(rows, FEATURES, SCENARIOS, ["id"])]
    for score in (model, line):
        frames += [W.scenario_results(rows, FEATURES, SCENARIOS, score, ["id"]), W.sensitivity(rows, FEATURES, score, ["id"])]
    for df in frames:
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
