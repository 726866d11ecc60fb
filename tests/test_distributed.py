"""Order-dependent operators against brute force, with one key holding most of the rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from millrace.operators import drift as D
from millrace.operators import models as M
from millrace.operators import ordered as O
from millrace.operators import prepare as R
from millrace.operators.distribution import exact_quantiles, kolmogorov_tail, two_sample_distance
from millrace.session import durable


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(1)
    n = 3000
    frame = pd.DataFrame({
        "k": np.where(rng.random(n) < 0.8, "hot", rng.integers(0, 9, n).astype(str)), "o": rng.permutation(n), "v": rng.integers(-50, 50, n).astype(float),
    })
    frame["known"] = frame.v.where(rng.random(n) < 0.2)
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "k string, o long, v double, known double").repartition(7), frame.sort_values(["k", "o"])


def test_running_totals_positions_extremes(hot):
    df, frame = hot
    got = O.running_totals(df, ["k"], ["o"], {"t": F.col("v")}).toPandas().sort_values(["k", "o"])
    assert np.allclose(got.t.values.astype(float), frame.groupby("k").v.cumsum().values)
    got = O.positions(df, [], ["o"], "p").toPandas()
    assert (got.p == got.o + 1).all()
    got = O.running_extreme(df, ["k"], ["o"], F.col("v"), "m").toPandas().sort_values(["k", "o"])
    assert np.allclose(got.m.values, frame.groupby("k").v.cummax().values)


def test_carry_last(hot):
    df, frame = hot
    got = O.carry_last(df, ["k"], ["o"], "known", "c").toPandas().sort_values(["k", "o"]).c.astype(float).values
    want = frame.groupby("k").known.ffill().values
    assert np.array_equal(np.nan_to_num(got, nan=1e9), np.nan_to_num(want, nan=1e9))


def test_positions_of_text_keys(spark):
    words = [f"{'aé'[i % 2]}{i:05d}" for i in range(500)]
    got = O.positions(spark.createDataFrame([(w,) for w in words], "w string").repartition(5), [], ["w"]).orderBy("position").toPandas()
    assert list(got.w) == sorted(words) and list(got.position) == list(range(1, 501))


def test_exact_quantiles(hot):
    df, frame = hot
    got = {r["share"]: r["value"] for r in exact_quantiles(df, ["v"], [0.1, 0.5, 0.99]).collect()}
    assert all(abs(v - np.quantile(frame.v, s)) < 1e-9 for s, v in got.items())


def test_two_sample_distance_and_tail(spark):
    a = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    b = spark.createDataFrame([(float(i + 10),) for i in range(100)], "x double")
    row = two_sample_distance(a, b, ["x"]).first()
    assert (row["n_reference"], row["n_current"]) == (100, 100) and abs(row["distance"] - 0.1) < 1e-12
    # Published 5 % and 1 % points of the limiting distribution, reached for very large samples.
    big = spark.range(1).select(*[kolmogorov_tail(F.lit(c / np.sqrt(5e11)), F.lit(int(1e12)), F.lit(int(1e12))).alias(n) for n, c in (("five", 1.3581), ("one", 1.6276))])
    got = big.first()
    assert abs(got["five"] - 0.05) < 1e-4 and abs(got["one"] - 0.01) < 1e-4


def test_drift_skips_empty_and_text_columns(spark):
    a = spark.createDataFrame([(1.0, None, "a"), (2.0, None, "b")], "x double, empty double, t string")
    assert [r["column"] for r in D.feature_drift(a, a).collect()] == ["x"]
    with pytest.raises(Exception, match="must not be empty"):
        D.prediction_drift(a.select(F.col("empty").alias("prediction")), a.select(F.col("x").alias("prediction"))).collect()


def test_degradation_and_rule(spark):
    table = lambda **m: spark.createDataFrame(list(m.items()), "metric string, value double")
    found = {r["metric"]: r["degraded"] for r in D.degradation(table(rmse=1.06, r2=0.96, new=1.0), table(rmse=1.0, r2=1.0, old=1.0)).collect()}
    assert found == {"rmse": True, "r2": False}


def test_splits_do_not_depend_on_partitioning(spark):
    df = spark.range(1000).withColumn("label", F.when(F.col("id") % 10 == 0, "rare").otherwise("common"))
    for split in (lambda d: R.hash_split(d, ["id"]), lambda d: R.stratified_split(d, "label", ["id"])):
        one = {r["id"] for r in split(df.coalesce(1)).where("is_test").collect()}
        many = {r["id"] for r in split(df.repartition(9)).where("is_test").collect()}
        assert one == many and 100 < len(one) < 300
    counts = {r["label"]: r["n"] for r in R.stratified_split(df, "label", ["id"]).where("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert counts == {"rare": 20, "common": 180}


def test_stratified_split_is_exact_at_any_depth(spark, monkeypatch):
    """Small ranges force several rounds of counting; the result is that of one full sort."""
    rows = [(i, None if i % 7 == 0 else f"c{min(i % 5, 2)}", i % 11) for i in range(3000)] + [(9000, "alone", 1)]
    df = spark.createDataFrame(rows, "id long, label string, other int").repartition(6)
    frame = df.withColumn("h", F.xxhash64("id", F.lit(42))).toPandas()
    want = {
        int(i) for _, part in frame.assign(label=frame.label.fillna("none")).groupby("label")
        for i in part.sort_values(["h", "id"]).head(int(np.ceil(len(part) * 0.2))).id
    }
    for few in (10_000, 3):
        monkeypatch.setattr(R, "RANGE_ROWS", few)
        for classes in (100_000, 0):
            monkeypatch.setattr(R, "BROADCAST_CLASSES", classes)
            assert {r["id"] for r in R.stratified_split(df, "label", ["id"]).where("is_test").collect()} == want
    assert R.stratified_split(df.limit(0), "label", ["id"]).collect() == []


def test_stratified_split_of_repeated_keys(spark):
    df = spark.createDataFrame([(i // 40, "a") for i in range(4000)], "id long, label string")
    got = R.stratified_split(df, "label", ["id"]).groupBy("id").agg(F.count_distinct("is_test").alias("n"), F.max("is_test").alias("t")).toPandas()
    assert (got.n == 1).all() and got.t.sum() == 20


def test_stratified_split_moves_no_wide_rows(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(200).selectExpr("id", "id % 3 AS label", "repeat('x', 50) AS wide").write.parquet(path)
    split = R.stratified_split(spark.read.parquet(path), "label", ["id"])
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Sort" not in plan


def test_preflight_guards_against_leaks(spark):
    df = spark.createDataFrame([(1, 2, 0.1, 0.2)], "feature_a long, feature_b long, target_a double, target_b double")
    row = R.preflight(df, ["feature_a", "feature_b", "target_a"], ["target_a", "target_b"]).first()
    assert row["ok"] and row["input_features"] == "feature_a,feature_b"
    assert R.preflight(df, ["gone"], ["target_a"]).first()["missing_columns"] == "gone"


def test_encoding_keeps_missing_indicator(spark):
    df = spark.createDataFrame([("x", None), ("y", 4.0)], "c string, v double")
    made = R.fit_features(df, ["c", "v"])
    assert made.transform(df).columns == ["v", "c_x", "c_y", "c_nan"]
    with pytest.raises(ValueError):
        made.transform(df, max_columns=2)
    assert [tuple(r) for r in made.transform(df).collect()] == [(4.0, 1.0, 0.0, 0.0), (4.0, 0.0, 1.0, 0.0)]


def test_ranges_of_long_prefixes_and_hot_first_values(spark):
    rows = [(0 if i % 10 else i, f"reference_with_a_long_prefix_{i:06d}") for i in range(4000)]
    df = spark.createDataFrame(rows, "a long, w string").repartition(6)
    for order in (["w"], ["a", "w"]):
        cuts = O.range_cuts(df, [], order, 16)
        sizes = df.groupBy(O.range_number(df, order, cuts).alias("r")).count().toPandas()["count"]
        assert len(sizes) == 16 and sizes.max() < 4 * sizes.mean()
        got = O.positions(df, [], order, "p", 16).orderBy(*order).toPandas()["p"].tolist()
        assert got == list(range(1, 4001))


def test_encoding_is_learnt_once(spark):
    words = [f"word{i:03d}" for i in range(200)]
    train = spark.createDataFrame([(i, w, float(i)) for i, w in enumerate(words)] + [(900, None, None)], "k long, w string, x double")
    found = R.fit_features(train, ["w", "x"])
    whole = {r["k"]: r["features"] for r in found.assemble(train, ["k"]).collect()}
    other = spark.createDataFrame([(5, "word005", 5.0), (901, "never seen", 1.0), (902, None, 0.0)], "k long, w string, x double")
    part = {r["k"]: r["features"] for r in found.assemble(other, ["k"]).collect()}
    assert part[5] == whole[5] and {v.size for v in [*part.values(), *whole.values()]} == {202}
    assert part[901].numNonzeros() == 1 and part[902].toArray()[201] == 1.0
    rows = {(r["k"], r["position"]): r["value"] for r in found.entries(other, ["k"]).collect()}
    assert rows == {(k, int(i)): float(v.toArray()[i]) for k, v in part.items() for i in v.toArray().nonzero()[0]}


def test_classes_are_sent_to_the_rows(spark, hot):
    """Rows of a class are never gathered in one task, neither for its code nor for its label."""
    df = hot[0]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        coded = R.encode_class(df, "k", "code")
        scored = coded.select("o", array_to_vector(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3))).alias("probability"))
        labels = durable(R.category_codes(df, "k"))
        shown = M.class_probabilities(scored, "o", labels, top=1)
        named = df.select(F.concat(F.lit("c"), "k").alias("k"))
        filled = R.fit_features(named, ["k"]).assemble(named)
        for joined in (coded, shown, filled):
            plan = joined._jdf.queryExecution().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        names = sorted(r.k for r in df.select("k").distinct().collect())
        assert all(r.code == names.index(r.k) for r in coded.collect())
        assert [tuple(r) for r in shown.groupBy("label", "place", "probability").count().collect()] == [(names[1], 1, 0.5, df.count())]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
