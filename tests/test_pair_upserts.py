"""Upserts of pairs: each side is dealt out with all its columns, so that a task sorts what a piece is meant to hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import registry as G


def test_sides_are_dealt_whole(spark):
    pairs = spark.range(400).select((F.col("id") % 20).alias("learning_model_id"), (F.col("id") % 7).alias("dataset_id")).distinct()
    words = lambda text: [F.lit(text).alias("name"), F.lit("/p").alias("path"), F.lit(1).alias("version"), F.create_map(F.lit("k"), F.lit(text)).alias("params")]
    stored = pairs.where("dataset_id < 5").select("*", *words("old"), F.array(F.lit("made")).alias("history"))
    incoming = pairs.where("dataset_id > 2").select("*", *words("new"), F.lit("sync").alias("entry"))
    made = G.upsert_pairs(stored, incoming)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(_deal") == 2
    rows = {(r["learning_model_id"], r["dataset_id"]): (r["name"], r["params"]["k"], r["history"]) for r in made.collect()}
    assert len(rows) == made.count() == 140
    assert rows[3, 1] == ("old", "old", ["made"]) and rows[3, 4] == ("old", "new", ["made", "sync"]) and rows[3, 6] == ("new", "new", ["sync"])
