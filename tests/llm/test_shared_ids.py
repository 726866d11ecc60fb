"""Rows that share an id, or have none, in near-duplicate detection and in training samples."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import minhash
from millrace.llm.labelled import training_sample


def text(rng, n=80):
    return " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))


def changed(body):
    words = body.split(" ")
    words[3] = "other"
    return " ".join(words)


@pytest.mark.parametrize("parts", [1, 4])
def test_every_text_of_an_id_links(spark, parts):
    rng = random.Random(1)
    a, b, c, d, e = (text(rng) for _ in range(5))
    rows = [(1, a), (1, b), (2, changed(a)), (3, changed(b)), (7, c), (None, changed(c)), (9, changed(changed(c)).replace("other", "third")),
            (None, d), (None, changed(d)), (11, e), (11, None), (12, None), (13, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = minhash.near_duplicates(df, 3, 85)
    rows_of = {}
    for r in got.collect():
        rows_of.setdefault(r.doc_id, []).append((r.component_id, r.kept, r.n_shingles > 0))
    assert sorted(rows_of[1]) == [(1, True, True)] * 2 and rows_of[2] == [(1, False, True)] and rows_of[3] == [(1, False, True)]
    assert rows_of[7] == [(7, True, True)] and rows_of[9] == [(7, False, True)]  # linked to each other or through the row without an id
    assert sorted(rows_of[None], key=str) == sorted([(7, False, True), (None, True, True), (None, True, True)], key=str)
    assert sorted(rows_of[11]) == [(11, True, False), (11, True, True)] and rows_of[12] == [(12, True, False)]


def test_row_without_an_id_bridges(spark):
    """Ends differ too much, the middle has no id."""
    rng = random.Random(2)
    words = text(rng, 100).split(" ")
    middle, last = list(words), list(words)
    middle[10] = last[10] = "x1"
    last[60], last[90] = "x2", "x3"
    middle[60] = "x2"
    first = list(words)
    rows = [(5, " ".join(first)), (None, " ".join(middle)), (4, " ".join(last))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(t.split(" ")[i : i + 3]) for i in range(98)} for _, t in rows]
    share = lambda x, y: 100 * len(x & y) / len(x | y)
    assert share(sets[0], sets[1]) >= 85 and share(sets[1], sets[2]) >= 85 > share(sets[0], sets[2])
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(df, 3, 85).collect()} == {(5, 4), (None, 4), (4, 4)}


def test_sample_keeps_its_bound(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(300)] + [(2, "b"), (3, "c"), (2, None)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    rows = training_sample(docs, labels, "toxic", 2).collect()
    assert sorted((r.doc_id, r.y) for r in rows) == [(1, 0), (2, 1)]
    again = training_sample(docs.repartition(7), labels, "toxic", 2).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    wanted = docs.where("doc_id = 1").orderBy(F.xxhash64("text"), "text").first().text
    assert {r.t for r in rows if r.doc_id == 1} == {wanted}
