"""Regression network: known functions, gradients, rows that cannot be used."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F, types as T

from millrace.operators import evaluate as E, networks
from millrace.operators.networks import _Gradient, fit_network_regressor
from millrace.plans import QUERIES

SCHEMA = T.StructType().add("features", VectorUDT()).add("label", "double")


def frame(spark, count=1500, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-2, 2, (count, 3))
    y = 3 * x[:, 0] - 2 * x[:, 1] * x[:, 0] + 5 * np.sin(x[:, 2]) + 40
    return spark.createDataFrame([(Vectors.dense(r), float(v)) for r, v in zip(x, y)], SCHEMA).repartition(4)


def test_fits_a_curved_function(spark):
    train, test = frame(spark), frame(spark, 400, 2)
    found = fit_network_regressor(train, (24,), epochs=150, step=0.05)
    losses = found.details["loss"]
    assert len(losses) == 150 and losses[0] > 0.5 > losses[40] > losses[-1] and losses[-1] < 0.03
    values = {r["metric"]: r["value"] for r in E.evaluate(found.transform(test), "label", "prediction", "regression").collect()}
    assert values["r2"] > 0.95
    assert "Python" not in found.transform(test)._jdf.queryExecution().toString()  # scoring is an expression


def test_same_fit_on_any_partitioning(spark):
    df = frame(spark, 300)
    a, b = (fit_network_regressor(d, (5, 4), epochs=8).details["loss"] for d in (df, df.repartition(7)))
    assert np.allclose(a, b, rtol=1e-6)


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(3)
    layers = [(rng.normal(size=(4, 3)), rng.normal(size=4)), (rng.normal(size=(1, 4)), rng.normal(size=1))]
    x, y = rng.normal(size=(20, 3)), rng.normal(size=20)
    mean, scale = np.zeros(4), np.ones(4)
    whole = _Gradient(layers, mean, scale)(x, y)
    at = 1
    for layer in layers:
        for part in layer:
            for i in np.ndindex(part.shape):
                part[i] += 1e-6
                more = _Gradient(layers, mean, scale)(x, y)[0]
                part[i] -= 2e-6
                less = _Gradient(layers, mean, scale)(x, y)[0]
                part[i] += 1e-6
                assert (more - less) / 2e-6 == pytest.approx(whole[at], rel=1e-4, abs=1e-4)
                at += 1


def test_rows_that_cannot_be_used(spark):
    df = frame(spark, 200)
    odd = spark.createDataFrame([(None, 1.0), (Vectors.dense([1.0, 2.0, 3.0]), None), (Vectors.dense([float("nan"), 2.0, 3.0]), 1.0), (Vectors.dense([1.0, 2.0, 3.0]), float("inf"))], SCHEMA)
    clean, mixed = (fit_network_regressor(d, (4,), epochs=3).details["loss"] for d in (df, df.unionAll(odd)))
    assert np.allclose(clean, mixed, rtol=1e-9)
    with pytest.raises(ValueError, match="No complete row"):
        fit_network_regressor(odd, (4,), epochs=1)
    constant = df.withColumn("label", F.lit(7.0))
    assert abs(fit_network_regressor(constant, (4,), epochs=30).transform(constant).agg(F.max("prediction")).first()[0] - 7.0) < 1.0


def test_equal_features_are_read_once(spark, monkeypatch):
    df = frame(spark, 300)
    copies = df.unionAll(df.withColumn("label", F.col("label") + 3)).unionAll(df.withColumn("label", F.col("label") - 1))
    kept, plain = [], networks.durable
    monkeypatch.setattr(networks, "durable", lambda rows: (kept.append(rows.count()), plain(rows))[1])
    found = fit_network_regressor(copies, (5,), epochs=6)
    assert kept == [300]
    pairs = [(r["features"].toArray(), r["label"]) for r in copies.collect()]
    x, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    net = found.model
    start = np.random.default_rng(42)
    layers = [(start.normal(0, 1 / np.sqrt(a), (b, a)), np.zeros(b)) for a, b in zip((3, 5), (5, 1))]
    mean, scale = np.append(x.mean(axis=0), y.mean()), np.append(x.std(axis=0), y.std())
    assert np.allclose(net.mean, mean[:-1]) and net.label_scale == pytest.approx(scale[-1])
    assert found.details["loss"][0] == pytest.approx(_Gradient(layers, mean, scale)(x, y)[0] / len(y))


def test_written_out_scores_are_the_same(spark, monkeypatch):
    df = frame(spark, 200).unionAll(spark.createDataFrame([(None, 1.0), (Vectors.dense([1.0, 2.0]), 1.0), (Vectors.dense([1.0, 2.0, 3.0, 4.0]), 1.0)], SCHEMA))
    found = fit_network_regressor(df.where("label <> 1"), (6, 4), epochs=3)
    shown = lambda: found.transform(df)
    written = shown()
    assert "lambda" not in written._jdf.queryExecution().toString().lower()
    monkeypatch.setattr(networks, "WRITTEN_OUT", 0)
    order = lambda out: sorted(str(r["prediction"]) for r in out.collect())
    assert order(written) == order(shown()) and order(written).count("None") == 3


def counted(monkeypatch):
    """The rows every sum over the training rows goes through, sum by sum."""
    read, plain = [], networks._summed

    def summed(rows, measure):
        *total, count = plain(rows, lambda *part: np.append(measure(*part), float(len(part[0]))))
        read.append(int(count))
        return np.array(total)

    monkeypatch.setattr(networks, "_summed", summed)
    return read


def test_every_epoch_of_the_query_goes_over_every_line(spark, monkeypatch, tmp_path):
    lines = spark.range(900).selectExpr("CAST(1 + id % 6 AS double) AS l_quantity", "id % 3 / 50.0D AS l_discount", "id % 2 / 25.0D AS l_tax")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))  # six different lines, each 150 times
    read = counted(monkeypatch)
    row = QUERIES["model_network_regression"](spark, str(tmp_path)).first()
    assert row["scored"] == 900 and row["epochs"] == 30
    assert read == [900] * 31  # means and deviations, then 30 epochs


def test_packed_rows_give_the_same_fit(spark, monkeypatch):
    odd = [(None, 1.0), (Vectors.dense([1.0, 2.0, 3.0]), None), (Vectors.dense([1.0, float("nan"), 3.0]), 1.0), (Vectors.dense([1.0, 2.0, 3.0]), float("inf"))]
    odd = spark.createDataFrame([*odd, (Vectors.sparse(3, {1: 2.0}), 39.0)], SCHEMA)
    df = frame(spark, 300)
    df = df.unionAll(df.withColumn("label", F.col("label") + 3)).unionAll(odd).repartition(5)
    with pytest.raises(ValueError, match="No complete row"):
        fit_network_regressor(odd.where("label IS NULL OR features IS NULL OR label <> 39"), (4,), epochs=1, merge=False)
    merged = fit_network_regressor(df, (5, 4), epochs=8)
    read = counted(monkeypatch)
    packed = fit_network_regressor(df, (5, 4), epochs=8, merge=False)
    assert read == [601] * 9
    assert np.allclose(merged.details["loss"], packed.details["loss"], rtol=1e-9)
    for (w, b), (v, c) in zip(merged.model.layers, packed.model.layers):
        assert np.allclose(w, v, rtol=1e-6) and np.allclose(b, c, rtol=1e-6, atol=1e-9)


def test_large_blocks_are_read_whole(monkeypatch):
    monkeypatch.setattr(networks, "AT_ONCE", 4)
    blocks = [np.arange(27.0).reshape(9, 3), np.arange(6.0).reshape(2, 3)]
    batch = pa.RecordBatch.from_arrays([pa.array([3, 3], pa.int32()), pa.array([b.tobytes() for b in blocks])], ["width", "block"])
    parts = list(networks._parts(batch))
    assert [len(y) for _, y, _, _ in parts] == [4, 4, 1, 2]
    assert np.array_equal(np.concatenate([np.column_stack([x, y]) for x, y, _, _ in parts]), np.concatenate(blocks))
    assert all((n == 1).all() and not spread.any() for _, _, n, spread in parts)
