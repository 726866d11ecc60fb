"""Fits that read equal rows once: the same models as on all rows, from as many rows as there are different ones."""

from __future__ import annotations

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from millrace.operators import models as M


@pytest.fixture(scope="module")
def rows(spark):
    made = spark.range(3000).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"))
    label = F.col("x") * F.col("y") + F.col("id") % 11
    return VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(made.withColumn("label", label)).select("features", "label").repartition(3)


@pytest.fixture
def read(monkeypatch):
    """Numbers of rows that boosting was given."""
    found = []
    for kind in (GBTRegressor, GBTClassifier):
        plain = kind.fit
        monkeypatch.setattr(kind, "fit", lambda self, df, *a, plain=plain: (found.append(df.count()), plain(self, df, *a))[1])
    return found


def predictions(model, rows):
    scored = model.transform(rows.dropDuplicates(["features"]))
    return {tuple(r["features"]): r["prediction"] for r in scored.collect()}


def test_boosted_regression(rows, read):
    plain = predictions(GBTRegressor(maxDepth=3, maxIter=5, seed=42).fit(rows), rows)
    read.clear()
    got = predictions(M.fit_regressor(rows, "GradientBoostingRegressor", max_depth=3, n_estimators=5), rows)
    assert read == [21] and got == pytest.approx(plain, rel=1e-9)


def test_missing_label_is_still_an_error(rows):
    odd = rows.withColumn("label", F.when(F.rand(1) > 0.001, F.col("label")))
    with pytest.raises(Exception, match="(?i)null|nan|label"):
        M.fit_regressor(odd, "GradientBoostingRegressor", max_depth=2, n_estimators=2)


def test_boosted_classes(rows, read):
    two = rows.withColumn("label", (F.col("label") > 8).cast("double"))
    plain = predictions(GBTClassifier(maxDepth=2, maxIter=4, seed=42).fit(two), two)
    different = two.distinct().count()
    read.clear()
    assert predictions(M.fit_classifier(two, "GradientBoostingClassifier", max_depth=2, n_estimators=4), two) == plain
    assert read == [different]


def test_boosted_classes_against_the_rest(rows, read):
    three = rows.withColumn("label", F.least(F.floor(F.col("label") / 6), F.lit(2)).cast("double"))
    predictions(M.fit_classifier(three, "GradientBoostingClassifier", classes=3, max_depth=2, n_estimators=2), three)
    assert read == [three.distinct().count()] * 3
