"""Vectors of every length are linked, each with its own length."""

from __future__ import annotations

import numpy as np

from millrace.llm import vectors


def test_two_lengths(spark):
    rng = np.random.default_rng(11)
    table = []
    for size in (16, 16, 8, 3, 1):
        centre = rng.standard_normal(size)
        for label in (0, 1):
            table += [(len(table) + k, (centre + s * rng.standard_normal(size)).tolist(), label) for k, s in enumerate((0.0, 0.0, 0.1, 0.3))]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in table}
    label = {i: k for i, _, k in table}
    links = {i: [j for j in unit if j != i and label[i] == label[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93] for i in unit}
    for chunk in (2048, 2):
        got = {r.vec_id: r for r in vectors.linked_vectors(df, 0.93, chunk=chunk).collect()}
        for i in unit:
            seen, todo = {i}, [i]
            while todo:
                new = set(links[todo.pop()]) - seen
                seen |= new
                todo += new
            assert (got[i].n_links, got[i].component_id) == (len(links[i]), min(seen))
