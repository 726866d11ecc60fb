"""Every registered query against its SQL, and checks of the plans."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from check import compare
from millrace.plans import COVERS, ORACLES, QUERIES

ROWS_ONLY = {
    "sink_vector_index", "model_regression", "model_classification", "model_probabilities",
    "model_clusters", "model_projection", "model_network", "model_outputs", "model_search", "model_monitoring", "model_retraining",
}
# A condition other than equality is the subject of this one query; its small side is one row per market segment.
NESTED_LOOP_ALLOWED = {"sql_theta_join"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    ok, note = compare(spark, duck, name, sf_dir, QUERIES[name], ORACLES.get(name))
    assert ok, note
    assert "TYPES" not in note, note


def test_registration():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(COVERS) == set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["order_id", "line_no", "net", "net_scaled"]


def _plan(df):
    return df.sparkSession.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = _plan(QUERIES["feature_filter_compare"](spark, sf_dir))
    assert "PushedFilters" in plan and "GreaterThanOrEqual(l_quantity,20.0)" in plan and "LessThanOrEqual(l_linenumber,4)" in plan
    plan = _plan(QUERIES["feature_flagship"](spark, sf_dir))
    assert "GreaterThanOrEqual(l_shipdate" in plan and "l_suppkey" not in plan and "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("name", [
    "feature_flagship", "feature_normalise", "drift_features", "whatif_step_grid", "registry_dependencies", "retrieval_triplets",
    "run_state_fold", "run_terminal_lines", "corpus_sync", "registry_upsert_pairs", "prepare_stratified_split", "sql_range_overlap", "sql_as_of",
])
def test_no_cross_joins(spark, sf_dir, name):
    plan = _plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_profile_scans_do_not_rise_with_text_columns(spark, tmp_path):
    from millrace.operators.profile import column_explorer

    scans = []
    for width in (2, 12):
        path = str(tmp_path / f"w{width}")
        spark.range(20).selectExpr("id", *[f"concat('t', id % {k + 2}) AS c{k}" for k in range(width)]).write.parquet(path)
        scans.append(_plan(column_explorer(spark.read.parquet(path), ["id"])).count("Scan parquet"))
    assert scans[0] == scans[1] <= 8  # formatted plans name every node twice
