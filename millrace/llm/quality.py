"""Quality grades by ordinal cumulative-link regression on hashed text.

One vector of weights over hashed features is shared by all grades; ordered thresholds cut its score:
the chance of grade k or better is the logistic function of (score - threshold k). Thresholds stay in
order because each is the one before plus a positive step. Features are relative frequencies of hashed
byte trigrams (case and marks count) and of words that repeat the word before or any word of the text.
Fitting takes at most ``SAMPLE`` graded texts; grading covers every whole text.

Defined results: NULL and empty texts have no features, their grade follows from the thresholds alone.
Grades are the distinct values in order; with fewer than two of them the only grade is certain.
Repeated rows get equal grades.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.hashedtext import byte_trigrams
from millrace.llm.labelled import training_sample
from millrace.llm.tables import saved
from millrace.llm.textbytes import SPACED, TextSlice, byte_view, distinct_per_doc, find_words, text_slices
from millrace.llm.toxicity import sigmoid

BITS = 14
EXTRA = 3  # share of words equal to the one before, share of words seen before, words per byte
WIDTH = (1 << BITS) + EXTRA
SLICE_BYTES = 1 << 18  # of text whose trigrams a task counts at once, at some 70 bytes of memory each
SAMPLE = 12_000
EPOCHS = 12
BATCH = 64
RATE, L2 = 0.3, 1e-6
KEEP_AT = 0.5


class Model(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray  # rising; one fewer than grades
    grades: list[int]


def features(part: TextSlice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of a slice: square roots of relative frequencies, which damp long tails."""
    rows = len(part.offsets) - 1
    doc, gram = byte_trigrams(part.data, part.offsets, BITS)
    both, counts = np.unique((doc << BITS) | gram, return_counts=True)
    at, gram = both >> BITS, both & ((1 << BITS) - 1)
    value = np.sqrt(counts / np.maximum(1, np.bincount(doc, minlength=rows))[at])
    words = find_words(part.data, part.offsets, SPACED)
    per_doc = np.maximum(1, np.bincount(words.doc, minlength=rows)) if len(words.doc) else np.ones(rows)
    same = np.zeros(len(words.doc), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    distinct = np.bincount(distinct_per_doc(words.doc, words.hash)[0], minlength=rows) if len(words.doc) else np.zeros(rows)
    every = np.arange(rows)
    extra = [
        np.bincount(words.doc, same, minlength=rows) / per_doc if len(words.doc) else np.zeros(rows),
        1 - distinct / per_doc,
        np.where(np.diff(part.offsets) > 0, per_doc / np.maximum(1, np.diff(part.offsets)), 0.0),
    ]
    return (
        np.concatenate([at, *[every] * EXTRA]),
        np.concatenate([gram, *[np.full(rows, (1 << BITS) + k) for k in range(EXTRA)]]),
        np.concatenate([value, *extra]),
    )


def _feature_rows(sample: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column(2), SLICE_BYTES):
                rows = len(part.offsets) - 1
                doc, feature, value = features(part)
                order = np.argsort(doc, kind="stable")
                ends = np.searchsorted(doc[order], np.arange(rows + 1))
                sorted_by_doc = (feature[order].astype(np.uint16), value[order].astype(np.float32))
                packs = [[x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])] for x in sorted_by_doc]
                at = slice(part.first, part.first + rows)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at], batch.column(1)[at], *[pa.array(p, pa.binary()) for p in packs]], ["doc_id", "y", "f", "v"])

    return sample.select("doc_id", "y", "t").mapInArrow(work, "doc_id long, y int, f binary, v binary")


def _examples(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(grade, features, values) of packed rows, as views of the batch."""
    f, f_at = byte_view(batch.column(2))
    v, v_at = byte_view(batch.column(3))
    for i, y in enumerate(batch.column(1).to_pylist()):
        yield y, f[f_at[i] : f_at[i + 1]].view(np.uint16), v[v_at[i] : v_at[i + 1]].view(np.float32)


def learn(examples: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, l2: float = L2) -> Model:
    """Adagrad on the likelihood of the graded examples (grade, features, values)."""
    grades = sorted({y for y, *_ in examples})
    cuts = len(grades) - 1
    weights, seen = np.zeros(WIDTH), np.full(WIDTH, 1e-8)
    if cuts < 1:
        return Model(weights, np.zeros(0), grades or [0])
    rank = {g: i for i, g in enumerate(grades)}
    y = np.array([rank[g] for g, *_ in examples])
    above = np.array([(y > k).mean() for k in range(cuts)]).clip(1e-4, 1 - 1e-4)
    first = -np.log(above / (1 - above))
    # First threshold, then logarithms of the steps to the next ones.
    cut = np.concatenate([first[:1], np.log(np.maximum(1e-3, np.diff(first)))])
    cut_seen = np.full(cuts, 1e-8)
    order = np.random.default_rng(11)
    for _ in range(epochs):
        shuffled = order.permutation(len(examples))
        for start in range(0, len(shuffled), BATCH):
            chosen = shuffled[start : start + BATCH]
            sizes = [len(examples[i][1]) for i in chosen]
            at = np.repeat(np.arange(len(chosen)), sizes)
            f = np.concatenate([examples[i][1] for i in chosen])
            v = np.concatenate([examples[i][2] for i in chosen])
            score = np.bincount(at, weights[f] * v, minlength=len(chosen))
            thresholds = np.cumsum(np.concatenate([cut[:1], np.exp(cut[1:])]))
            # Chance of the grade: tail(y - 1) - tail(y), with tail(-1) = 1 and tail(last) = 0.
            tail = np.hstack([np.ones((len(chosen), 1)), sigmoid(score[:, None] - thresholds[None, :]), np.zeros((len(chosen), 1))])
            slope = tail * (1 - tail)
            k, i = y[chosen], np.arange(len(chosen))
            chance = np.maximum(1e-9, tail[i, k] - tail[i, k + 1])
            by_score = (slope[i, k] - slope[i, k + 1]) / chance
            by_cut = np.zeros((len(chosen), cuts + 2))
            by_cut[i, k] -= slope[i, k] / chance
            by_cut[i, k + 1] += slope[i, k + 1] / chance
            by_cut = by_cut[:, 1:-1].sum(axis=0) / len(chosen)
            gradient = np.bincount(f, by_score[at] * v, minlength=WIDTH) / len(chosen) - l2 * weights
            touched = np.unique(f)
            seen[touched] += gradient[touched] ** 2
            weights[touched] += rate * gradient[touched] / np.sqrt(seen[touched])
            by_step = np.cumsum(by_cut[::-1])[::-1] * np.concatenate([[1.0], np.exp(cut[1:])])
            cut_seen += by_step**2
            cut += rate * by_step / np.sqrt(cut_seen)
    return Model(weights, np.cumsum(np.concatenate([cut[:1], np.exp(cut[1:])])), grades)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", allowed: Column | None = None, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` graded texts; a few hundred KB reach the driver."""
    rows = saved(_feature_rows(training_sample(docs, labels, label, sample, allowed)), "quality-features")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = learn([example for batch in batches for example in _examples(batch)])
        yield pa.RecordBatch.from_arrays(
            [pa.array([x.tobytes()], pa.binary()) for x in (model.weights, model.thresholds, np.array(model.grades, np.int64))], ["w", "c", "g"]
        )

    row = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "f").mapInArrow(work, "w binary, c binary, g binary").first()
    if row is None:  # nothing is graded
        return learn([])
    return Model(np.frombuffer(row["w"]), np.frombuffer(row["c"]), np.frombuffer(row["g"], np.int64).tolist())


def grade(docs: DataFrame, model: Model, text: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The table with expected_grade, tail_probability (of the best grade) and accepted.

    ``accepted``: the chance of the best grade is at least ``keep_at``.
    """
    names = docs.columns
    made = ["expected_grade", "tail_probability", "accepted"]
    named = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], F.col(f"`{text}`").cast("string").alias("_t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        steps = np.diff(np.array(own.grades, float))
        for batch in batches:
            expected, best = [np.zeros(0)], [np.zeros(0)]
            for part in text_slices(batch.column(batch.num_columns - 1), SLICE_BYTES):
                doc, feature, value = features(part)
                score = np.bincount(doc, own.weights[feature] * value, minlength=len(part.offsets) - 1)
                tails = sigmoid(score[:, None] - own.thresholds[None, :])
                expected.append(own.grades[0] + (tails * steps[None, :]).sum(axis=1))
                best.append(tails[:, -1] if tails.shape[1] else np.ones(len(score)))
            tail = np.concatenate(best)
            columns = [pa.array(np.concatenate(expected), pa.float64()), pa.array(tail, pa.float64()), pa.array(tail >= keep_at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], *made])

    schema = named.drop("_t").schema.add(made[0], "double").add(made[1], "double").add(made[2], "boolean")
    result = named.mapInArrow(work, schema)
    return result.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names) if c.lower() not in made], *made)
