"""Every stage of the pipeline against brute force on its own input."""

from __future__ import annotations

import collections
import hashlib

import pytest

import corpus_pipeline as P
from millrace.llm import decontaminate
from tests.llm.test_llm_operators import shingles


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    """(name, rows in, rows out) of every stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0), (10**9, "", "en", "s", 0)], docs.schema)
    docs = P.saved(docs.union(odd), "test-in")
    out = []
    for name, stage in P.STAGES:
        after = P.saved(stage(spark, docs, sf_dir), "test-stage")
        out.append((name, [r.asDict() for r in docs.collect()], [r.asDict() for r in after.collect()]))
        docs = after
    return out


def stage(tables, word):
    return next((before, after) for name, before, after in tables if word in name)


def test_order_and_columns(tables):
    assert [name for name, *_ in tables] == ["quality classifier", "MinHash near-dedup", "suffix-array dedup", "benchmark decontamination", "byte-level BPE encoding and decoding"]
    for _, before, after in tables[:-1]:
        assert list(after[0]) == list(before[0]) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_rejected_documents_go(spark, sf_dir, tables):
    before, after = stage(tables, "quality")
    grade = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after}
    assert all((r["doc_id"] in kept) == bool(grade[r["doc_id"]]) for r in before if r["doc_id"] in grade)
    known = {(r["doc_id"], r["text"]) for r in before}
    assert all((r["doc_id"], r["text"]) in known for r in after)


def test_one_document_of_each_group_stays(tables):
    before, after = stage(tables, "MinHash")
    sets = {r["doc_id"]: shingles(r["text"], P.SHINGLE) for r in before if r["doc_id"] is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    for i, s in sets.items():
        for j, both in collections.Counter(j for g in s for j in where[g] if j < i).items():
            if 100 * both >= P.PERCENT * len(s | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = sorted({find(i) for i in sets})
    assert sorted(r["doc_id"] for r in after if r["doc_id"] is not None) == want
    assert sum(r["doc_id"] is None for r in after) == sum(r["doc_id"] is None for r in before)


def test_repeats_are_cut(tables):
    before, after = stage(tables, "suffix")
    size = P.REPEAT_BYTES
    bodies = [(r["doc_id"], (r["text"] or "").encode()) for r in before]
    count = collections.Counter(b[s : s + size] for _, b in bodies for s in range(len(b) - size + 1))
    want = collections.Counter()
    for i, b in bodies:
        cover = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if count[b[s : s + size]] > 1:
                cover[s : s + size] = b"\1" * size
        kept = bytes(x for x, c in zip(b, cover) if not c)
        if kept or not b:
            want[i, kept.decode("utf-8", "ignore")] += 1
    assert collections.Counter((r["doc_id"], r["text"] or "") for r in after) == want
    old = {r["doc_id"]: r for r in before}
    for r in after:
        if r["text"] != old[r["doc_id"]]["text"]:
            assert r["n_chars"] == len(r["text"])


def test_benchmark_passages_go(spark, sf_dir, tables):
    before, after = stage(tables, "decontamination")
    split = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split(" ") if w]
    items = [split(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    index = collections.defaultdict(list)
    for item in items:
        for n, mask in enumerate(decontaminate.MASKS):
            for p in range(len(item) - mask[-1]):
                index[n, tuple(item[p + k] for k in mask)].append((item, p))

    def leaks(words):
        for n, mask in enumerate(decontaminate.MASKS):
            for a in range(len(words) - mask[-1]):
                for item, p in index.get((n, tuple(words[a + k] for k in mask)), ()):
                    width = min(20, len(item))
                    same = [0 <= p + j < len(item) and 0 <= a + j < len(words) and item[p + j] == words[a + j] for j in range(-19, 29)]
                    if max(sum(same[s : s + width]) for s in range(len(same) - width + 1)) >= 0.8 * width:
                        return True
        return False

    want = collections.Counter((r["doc_id"], r["text"]) for r in before if r["doc_id"] is None or not leaks(split(r["text"])))
    assert collections.Counter((r["doc_id"], r["text"]) for r in after) == want


def test_encoding_round_trip(tables):
    before, after = stage(tables, "BPE")
    assert len(after) == len(before) and all(r["round_trip"] and len(r["ids"]) == r["n_tokens"] for r in after)
    assert collections.Counter(r["decoded_sha256"] for r in after) == collections.Counter(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in before)


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, function in P.STAGES:
        docs = P.saved(function(spark, docs, sf_dir), "test-empty")
        assert docs.count() == 0
