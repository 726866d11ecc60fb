from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.functions.values import canonical_scalar
from millrace.operators import features as X
from millrace.operators.sqlmode import fingerprint, guard, run_sql


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_rename_fill_sort(spark):
    df = spark.createDataFrame([(10.0, "a", 0), (None, "b", 0), (30.0, "c", 1)], "raw_amount double, category string, target int")
    made = X.apply_feature_operations(df, {
        "rename_columns": {"raw_amount": "amount"}, "fill_missing_values": {"amount": {"strategy": "median"}},
        "sort_by": {"column": "amount", "ascending": False},
    }).frame
    assert made.columns == ["amount", "category", "target"]
    assert rows(made) == [(30.0, "c", 1), (20.0, "b", 0), (10.0, "a", 0)]


def test_limit_is_at_least_one(spark):
    df = spark.createDataFrame([(1, 0), (2, 1)], "feature long, target int")
    assert X.apply_feature_operations(df, {"limit_rows": -3}).frame.count() == 1
    assert X.apply_feature_operations(df, {"limit_rows": "0"}).frame.count() == 2


def test_math_normalise_and_date_range(spark):
    df = spark.createDataFrame(
        [(10.0, 1.0, "2024-01-01", 0), (20.0, 2.0, "2024-01-02", 1), (30.0, 3.0, "2024-02-01", 1)],
        "feature_a double, feature_b double, event_date string, target int",
    )
    made = X.apply_feature_operations(df, {
        "math_operations": [{"column": "feature_a", "operator": "subtract", "value_mode": "column", "right_column": "feature_b", "target": "gap"}],
        "normalize": [{"columns": ["feature_a"], "min": 0, "max": 1, "target_suffix": "_scaled"}],
        "date_range_filters": [{"column": "event_date", "start": "2024-01-01", "end": "2024-01-31"}],
    }).frame.orderBy("event_date")
    got = made.select("gap", "feature_a_scaled").collect()
    assert len(got) == 2 and got[0]["gap"] == 9.0 and got[0]["feature_a_scaled"] == 0.0


def test_missing_values_in_filters_and_scaling(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan")), (4, 5.0)], "k int, x double")
    keep = lambda op, v: [r[0] for r in X.apply_feature_operations(df.withColumn("x", F.nanvl("x", F.lit(None))), {"filters": [{"column": "x", "operator": op, "value": v}]}).frame.orderBy("k").collect()]
    assert keep("neq", 1.0) == [2, 3, 4]
    assert keep("gt", 0) == [1, 4]
    assert keep("lte", 5) == [1, 4]
    scaled = X.normalise(df, {"columns": ["x"]}).orderBy("k").collect()
    assert [r["x"] for r in scaled] == [0.0, None, None, 1.0]
    constant = X.normalise(spark.createDataFrame([(2.0,), (None,)], "x double"), {"columns": ["x"], "min": 3})
    assert [r[0] for r in constant.collect()] == [3.0, 3.0]


def test_casts_and_infinities(spark):
    df = spark.createDataFrame([("3.7",), ("4",), ("1d",), ("inf",), (None,)], "t string")
    out = df.select(X.cast_column(F.col("t"), df.schema["t"].dataType, "int").alias("i"), X.cast_column(F.col("t"), df.schema["t"].dataType, "float").alias("f"))
    assert rows(out) == [(None, 3.7), (4, 4.0), (None, None), (None, None), (None, None)]
    powered = X.apply_feature_operations(spark.createDataFrame([(10.0,)], "x double"), {"math_operations": [{"column": "x", "operator": "power", "value": 400}]})
    assert powered.frame.first()[0] is None


def test_divide_by_literal_zero_is_skipped(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    made = X.apply_feature_operations(df, {"math_operations": [{"column": "x", "operator": "divide", "value": 0, "target": "y"}]})
    assert made.frame.columns == ["x"] and made.steps == []


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert {r[0] for r in X.fill(df, {"c": {"strategy": "mode"}}).collect()} == {"a", "b"}
    assert X.fill(df, {"c": {"strategy": "mode"}}).where("c = 'a'").count() == 3


def test_required_columns(spark):
    with pytest.raises(ValueError, match="y, z"):
        X.require_columns(spark.range(1), ["id", "y", "z"])


def test_canonical_scalar(spark):
    df = spark.createDataFrame([("0",), ("0.0",), (" 0.50 ",), ("True",), ("abc",), (None,), ("0.1234567890123456",)], "v string")
    assert [r[0] for r in df.select(canonical_scalar(F.col("v"))).collect()] == ["0", "0", "0.5", "true", "abc", "", "0.123456789012"]


@pytest.mark.parametrize("bad", [
    "", "SELECT * FROM source_dataset; SELECT 1", "DROP TABLE source_dataset", "UPDATE source_dataset SET a = 1", "SELECT 1",
    "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM source_dataset", "SELECT 'source_dataset'",
])
def test_guard_refuses(bad):
    with pytest.raises(ValueError):
        guard(bad)


def test_guard_accepts_words_in_strings_and_comments():
    text = "SELECT 'drop; table' AS x -- delete\nFROM source_dataset /* update */;"
    assert guard(text).startswith("SELECT") and len(fingerprint(text)) == 12


def test_sql_leaves_no_views_behind(spark):
    left = spark.createDataFrame([(1, 2.0)], "id int, feature double")
    right = spark.createDataFrame([(1, "x")], "id int, label string")
    got = run_sql("SELECT s.id, r.label FROM source_dataset s JOIN secondary_dataset r ON s.id = r.id", left, right, preview_rows=5)
    assert [t.name for t in spark.catalog.listTables() if t.isTemporary] == []
    assert rows(got) == [(1, "x")]


def test_sql_mode_keeps_to_its_relations(spark, tmp_path):
    from millrace.operators import sqlmode as Q

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, w string")
    spark.createDataFrame([(9,)], "mine int").createOrReplaceTempView("source_dataset")
    assert Q.run_sql("SELECT count(*) AS n FROM source_dataset", df).first()["n"] == 2
    assert spark.table("source_dataset").columns == ["mine"]
    df.write.parquet(str(tmp_path / "t"))
    with pytest.raises(Exception):
        Q.run_sql(f"SELECT * FROM source_dataset JOIN parquet.`{tmp_path}/t` USING (id)", df).collect()
    with pytest.raises(ValueError):
        Q.run_sql("SELECT reflect('java.lang.System', 'getProperty', w) FROM source_dataset", df)
    spark.catalog.dropTempView("source_dataset")
