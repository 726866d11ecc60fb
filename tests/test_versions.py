"""Replaced tables: a write that fails, or is repeated, never hides the version before it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.operators import sinks as S
from millrace.operators import versions as R


def test_failed_write_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "t")
    R.replace_version(spark.range(10), root)
    broken = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        R.replace_version(broken, root)
    assert R.read_version(spark, root).count() == 10 and R.history(spark, root).count() == 1
    R.replace_version(spark.range(3), root)
    assert R.read_version(spark, root).count() == 3 and R.read_version(spark, root, 1).count() == 10
    assert {(r["version"], r["rows"], r["columns"]) for r in R.history(spark, root).collect()} == {(1, 10, 1), (2, 3, 1)}


def test_written_folder_without_its_line_is_not_read(spark, tmp_path):
    root = str(tmp_path / "t")
    R.replace_version(spark.range(4), root)
    spark.range(9).write.parquet(f"{root}/data-lost")
    assert R.read_version(spark, root).count() == 4


def test_a_version_may_read_the_one_before(spark, tmp_path):
    root = str(tmp_path / "t")
    R.replace_version(spark.range(4), root)
    R.replace_version(R.read_version(spark, root).withColumn("twice", F.col("id") * 2), root)
    assert R.read_version(spark, root).columns == ["id", "twice"]
    with pytest.raises(ValueError, match="No such version"):
        R.read_version(spark, root, 9)
    with pytest.raises(ValueError, match="No such version"):
        R.read_version(spark, str(tmp_path / "none"))


def test_empty_view_and_catalog_view(spark, tmp_path):
    root = str(tmp_path / "t")
    row = S.materialise_view(spark.range(0), "nothing", root, source="4").first()
    assert list(row["shape"]) == [0, 1] and row["version"] == 1 and row["connection_string"] == "table:nothing"
    for rows in (5, 8):
        row = S.materialise_view(spark.range(rows), "numbers", root, "sql", "4", "5", "abc", table="numbers_view").first()
        assert spark.table("numbers_view").count() == rows and row["history"][0]["materialized"] and row["history"][0]["sql_hash"] == "abc"
    assert row["version"] == 3 and row["connection_string"] == "table:numbers_view"
    spark.sql("DROP VIEW numbers_view")


def test_upserts_start_from_nothing(spark, tmp_path):
    root = str(tmp_path / "pairs")
    schema = "learning_model_id int, dataset_id int, name string, path string, version int, params map<string,string>, entry string"
    first = spark.createDataFrame([(1, 1, "a", None, None, {"x": "1"}, "made")], schema)
    again = spark.createDataFrame([(1, 1, "b", "/p", 2, {"y": "2"}, "sync"), (1, 2, "c", None, None, None, None)], schema)
    assert S.upsert_to(root, first).count() == 1
    got = {r["dataset_id"]: r for r in S.upsert_to(root, again).collect()}
    assert got[1]["history"] == ["made", "sync"] and got[1]["params"] == {"x": "1", "y": "2"} and got[1]["path"] == "/p" and got[2]["history"] == []
