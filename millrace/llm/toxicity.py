"""Toxicity scores by logistic regression, learnt with FTRL-proximal.

Features are presences of hashed words, neighbouring pairs, pairs with one word between, and the
first letters of longer words, so that unseen forms of a known word count. Each coordinate has its own learning rate, and the L1 term keeps weights at zero until enough evidence is
seen, so the weights sent to the scoring tasks are few. Fitting takes at most ``SAMPLE`` labelled texts
(those with the smallest hashed ids); their features are made by the cluster and learnt in one task.
Scoring covers every whole text.

Defined results: NULL and wordless texts get the score of the bias alone. Without any label, or with
one class only, the bias carries what is known; without labels every score is 0.5. Labels of other
values than 0 and 1 count as 1 if positive. Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.hashedtext import distinct_pairs, stem_grams, word_grams
from millrace.llm.labelled import training_sample
from millrace.llm.tables import saved
from millrace.llm.textbytes import ALPHANUMERIC, TextSlice, find_words, text_slices

BITS = 20
SAMPLE = 16_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 5.0, 0.1


class Ftrl:
    """Follow the regularised leader, one example after another."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last coordinate is the bias
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        w[np.abs(z) <= self.l1] = 0.0
        return w

    def bias(self) -> float:
        return float(-self.z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.alpha))  # not regularised

    def learn(self, features: np.ndarray, label: float) -> None:
        w, b = self.weights(features), self.bias()
        p = sigmoid(w.sum() + b)
        g = p - label
        step = (np.sqrt(self.n[features] + g * g) - np.sqrt(self.n[features])) / self.alpha
        self.z[features] += g - step * w
        self.n[features] += g * g
        step = (np.sqrt(self.n[-1] + g * g) - np.sqrt(self.n[-1])) / self.alpha
        self.z[-1] += g - step * b
        self.n[-1] += g * g


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def features(part: TextSlice) -> tuple[np.ndarray, np.ndarray]:
    words = find_words(part.data, part.offsets, ALPHANUMERIC)
    pairs = [word_grams(words, BITS), stem_grams(part.data, words, BITS)]
    return np.concatenate([d for d, _ in pairs]), np.concatenate([f for _, f in pairs])


def feature_rows(sample: DataFrame) -> DataFrame:
    """(doc_id, y, f): distinct features of each training text as packed 32-bit numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column(2)):
                rows = len(part.offsets) - 1
                doc, feature = distinct_pairs(*features(part), BITS)
                ends = np.searchsorted(doc, np.arange(rows + 1))
                packed = [feature[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:])]
                at = slice(part.first, part.first + rows)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at], batch.column(1)[at], pa.array(packed, pa.binary())], ["doc_id", "y", "f"])

    return sample.select("doc_id", "y", "t").mapInArrow(work, "doc_id long, y int, f binary")


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, label: str = "toxic", sample: int = SAMPLE, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias): only non-zero weights, at most 2 to the power ``BITS``."""
    rows = saved(feature_rows(training_sample(docs, labels, label, sample, allowed)), "toxicity-features")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = [
            (np.frombuffer(f, np.int32), float(y > 0)) for batch in batches for y, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
        ]
        model = Ftrl(1 << BITS)
        order = np.random.default_rng(7)
        for _ in range(epochs):
            for i in order.permutation(len(examples)):
                model.learn(*examples[i])
        w = model.weights(np.arange(1 << BITS))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(w[at], model.bias() if examples else 0.0))], ["feature", "weight"]
        )

    # The sample is bounded, so one task may hold it; sorting makes the result the same every time.
    learnt = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "f").mapInArrow(work, "feature long, weight double").collect()
    weights = {r["feature"]: r["weight"] for r in learnt}
    bias = weights.pop(-1, 0.0)
    at = np.array(sorted(weights), np.int64)
    return at, np.array([weights[int(i)] for i in at]), bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", into: str = "score") -> DataFrame:
    """The table with the score of each whole text in column ``into``."""
    at, weights, bias = model
    names = docs.columns
    named = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], F.col(f"`{text}`").cast("string").alias("_t"))
    shared = docs.sparkSession.sparkContext.broadcast((at, weights))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS)
        dense[shared.value[0]] = shared.value[1]
        some = dense != 0
        for batch in batches:
            scores = []
            for part in text_slices(batch.column(batch.num_columns - 1)):
                doc, feature = features(part)
                known = some[feature]
                doc, feature = distinct_pairs(doc[known], feature[known], BITS)
                total = np.bincount(doc, dense[feature], minlength=len(part.offsets) - 1)
                scores.append(sigmoid(total + bias))
            column = pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], [*batch.schema.names[:-1], "_s"])

    result = named.mapInArrow(work, named.drop("_t").schema.add("_s", "double"))
    return result.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names) if c.lower() != into.lower()], F.col("_s").alias(into))
