"""Rows whose id is NULL or shared are judged by their own text."""

from __future__ import annotations

import random

import corpus_pipeline as P
from millrace.llm import decontaminate

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def test_near_copies_without_ids(spark, sf_dir):
    a, b, c = words(1, 80), words(2, 80), words(3, 80)
    docs = table(spark, [(None, a), (None, a), (None, a + " end"), (7, b), (None, b), (9, c), (4, c), (None, None), (None, "")])
    after = P.saved(P.minhash_near_dedup(spark, docs, sf_dir), "test-ids")
    got = [(r.doc_id, r.text) for r in after.collect()]
    assert sorted(i for i, _ in got if i is not None) == [4, 7] and (None, None) in got and (None, "") in got
    assert sum((t or "").startswith(a) for _, t in got) == 1 and len(got) == 5
    # The clean text that is left survives the cutting of repeats.
    assert any((r.text or "").startswith(a) for r in P.suffix_array_dedup(spark, after, sf_dir).collect())


def test_different_texts_of_one_id_stay(spark, sf_dir):
    a, b = words(4, 80), words(5, 80)
    docs = table(spark, [(1, a), (1, b), (1, None), (1, a), (2, b + " end"), (3, None)])
    got = sorted((r.doc_id, r.text or "") for r in P.minhash_near_dedup(spark, docs, sf_dir).collect())
    assert got == sorted([(1, a), (1, b), (1, ""), (3, "")])


def test_contamination_without_ids(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    docs = table(spark, [(None, "so " + item), (None, words(6, 50)), (None, None), (3, item), (4, words(7, 50))])
    after = P.benchmark_decontamination(spark, docs, sf_dir).collect()
    assert {(r.doc_id, r.text) for r in after} == {(None, words(6, 50)), (None, None), (4, words(7, 50))}
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()
    assert len(found) == 5 and sorted((r.doc_id or 0) for r in found if r.contaminated) == [0, 3]
