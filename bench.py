"""Time the headline queries: one JSON line on stdout.

Each query runs once cold and once warm in one session; ``queries`` holds the warm time, ``first``
the cold one. The results are fully computed and discarded. ``budgets`` repeats three
time limits known for a table of 500 rows × 81 columns, on a table of that shape.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from millrace.operators import prepare as R
from millrace.operators import profile as P
from millrace.operators import sinks as S
from millrace.plans import QUERIES
from millrace.plans.registry import table
from millrace.session import build_session, scratch_path
from millrace.sources import readers

HEADLINE = (
    "feature_flagship", "feature_casts", "feature_fill", "feature_math", "feature_normalise", "feature_filter_not_equal",
    "sql_joins", "sql_semi_anti", "sql_range_overlap", "sql_as_of", "sql_group_by", "sql_analytic_windows",
    "profile_column_explorer", "profile_fingerprint", "eval_regression", "eval_classification_macro", "drift_features", "drift_degradation",
    "prepare_encode_features", "prepare_class_target", "prepare_stratified_split",
    "corpus_references", "corpus_sync", "corpus_snapshot", "corpus_token_statistics", "corpus_redact_text",
    "retrieval_hashed_embeddings", "retrieval_search_text", "retrieval_triplets", "retrieval_lexical_rank",
    "registry_dependencies", "registry_upsert_pairs", "catalog_details", "run_state_fold", "run_terminal_lines", "run_compute_target", "log_snapshot",
    "whatif_scenario_results", "whatif_sensitivity", "model_best_so_far",
)


def run(build) -> float:
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": str(2 * int(cpus) if cpus.isdigit() else 8), "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    table(spark, sf_dir, "lineitem").agg(F.sum("l_quantity")).collect()  # start the executor threads
    names = [n for n in sys.argv[1:] if n in QUERIES] or list(HEADLINE)
    first, warm = {}, {}
    for name in names:
        first[name] = run(lambda: QUERIES[name](spark, sf_dir))
        warm[name] = run(lambda: QUERIES[name](spark, sf_dir))
    budgets = {}
    if not sys.argv[1:]:
        wide = table(spark, sf_dir, "orders").orderBy("o_orderkey").limit(500).select(
            *[(F.col("o_orderkey") + i).alias(f"feature_{i:03d}") for i in range(80)], (F.col("o_orderkey") % 2).alias("target")
        )
        path = scratch_path(spark, "wide")
        S.export_csv(wide.coalesce(1), path)
        steps = {
            "wide_parse": lambda: readers.read_delimited(spark, path).frame,
            "wide_profile": lambda: P.column_explorer(readers.read_delimited(spark, path).frame, ["feature_000"]),
            "wide_preflight": lambda: R.preflight(readers.read_delimited(spark, path).frame),
        }
        for name, step in steps.items():
            cold = run(step)
            budgets[name] = {"limit": 1.5 if name == "wide_preflight" else 2.5, "first": cold, "warm": run(step)}
    print(json.dumps({
        "metric": "total warm seconds of the headline queries", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "first": first, "budgets": budgets, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
