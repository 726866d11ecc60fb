"""Decontamination against a brute force that compares windows without seeds."""

from __future__ import annotations

import itertools
import random

from millrace.llm import decontaminate


def test_every_admitted_pattern_leaves_a_mask():
    for width in range(decontaminate.MIN_WORDS, decontaminate.WINDOW + 1):
        masks = decontaminate.masks_of(width)
        changes = max(c for c in range(width) if (width - c) / width >= decontaminate.SHARE)
        stretches = [{p + k for k in m} for m in masks for p in range(width - m[-1])]
        for hit in itertools.combinations(range(width), changes):
            assert any(not s.intersection(hit) for s in stretches), (width, hit)


def test_changed_items_are_found(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    items = {n: [word() for _ in range(n)] for n in (5, 6, 7, 8, 9, 10, 11, 13, 15, 20, 27)}
    docs = {}
    for n, item in items.items():
        width = min(n, decontaminate.WINDOW)
        changes = max(c for c in range(width) if (width - c) / width >= decontaminate.SHARE)
        patterns = list(itertools.combinations(range(n), changes))
        for hit in rng.sample(patterns, min(len(patterns), 45)):
            for more in (0, 1):
                changed = {*hit, *rng.sample([k for k in range(n) if k not in hit], more)}
                body = [word() if k in changed else w for k, w in enumerate(item)]
                docs[len(docs)] = [word() for _ in range(3)] + body + [word()]

    def shares(words, item):
        width = min(len(item), decontaminate.WINDOW)
        pairs = ((a, b) for a in range(len(words) - width + 1) for b in range(len(item) - width + 1))
        return max(sum(x == y for x, y in zip(words[a : a + width], item[b : b + width])) / width for a, b in pairs)

    want = {(i, n) for i, words in docs.items() for n, item in items.items() if len(words) >= min(n, 20) and shares(words, item) >= decontaminate.SHARE}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(df, bench).collect()} == want
