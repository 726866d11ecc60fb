"""Embeddings are made where a record lies: no shuffle, no join, and the vectors that the words call for."""

from __future__ import annotations

import math
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from millrace.operators import retrieval as R
from millrace.plans import QUERIES


def vector(words, size):
    out = [0.0] * size
    for w in words:
        d = sha256(w.encode()).digest()
        out[int.from_bytes(d[:4], "big") % size] += (-1 if d[4] % 2 else 1) * (1 + math.log(1 + len(w)))
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm if norm else 0.0 for x in out]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_is_built_in_place(spark):
    texts = {"a": "The cat, the hat", "b": "", "c": None, "d": " été 2024 \U0001f600 x", "e": "--"}
    words = {"a": ["the", "cat", "the", "hat"], "b": ["empty"], "c": ["empty"], "d": ["été", "2024", "x"], "e": ["empty"]}
    made = R.build_index(spark.createDataFrame(list(texts.items()), "reference_id string, text string"), 16)
    assert "Exchange" not in plan(made) and "Join" not in plan(made)
    got = {r["reference_id"]: r["embedding"] for r in made.collect()}
    assert got == {k: pytest.approx(vector(w, 16)) for k, w in words.items()}
    assert R.index_status(made.where("reference_id = 'none'")).first()["status"] == "empty"


def test_rows_that_share_a_key_are_one_text(spark):
    rows = spark.createDataFrame([(1, "one two"), (1, "three"), (2, None)], "id int, t string").repartition(3)
    got = {r["id"]: r["embedding"] for r in R.hashed_embeddings(rows, "id", "t", 8).collect()}
    assert got == {1: pytest.approx(vector(["one", "two", "three"], 8)), 2: pytest.approx(vector(["empty"], 8))}


def test_search_text_does_not_gather_documents(spark, sf_dir):
    shown = plan(QUERIES["retrieval_search_text"](spark, sf_dir))
    assert "hashpartitioning" not in shown and "Join" not in shown
