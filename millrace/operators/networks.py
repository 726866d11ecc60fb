"""Feed-forward networks for regression, fitted by sums of gradients over all rows.

Each step every task adds up the gradient of its rows; the sums meet in a few tasks and one small result reaches the driver,
which moves the weights (Adam). What a step sends has the size of the weights. Rows are either merged once by equal features,
with the number, mean label and spread that give the same gradient and loss, or packed once, all of them, into blocks of numbers.
Features and labels are scaled by the mean and deviation of the training rows. Scoring is a Spark expression.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.models import Fitted
from millrace.session import durable
from millrace.sources.readers import spread_rows

#: Tasks in which the gradient sums of all others meet. Weights up to which scoring is written out term by term, as compiled code.
#: Rows of a block whose layers are computed at once, few enough to stay in a core's cache.
MEETING, WRITTEN_OUT, AT_ONCE = 16, 500, 2000

Layer = tuple[np.ndarray, np.ndarray]  # weights (outputs, inputs), bias


@dataclass
class Network:
    """Layers with hyperbolic tangents between them and the scales of features and label."""

    layers: list[Layer]
    mean: np.ndarray
    scale: np.ndarray
    label_mean: float
    label_scale: float

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` from the vector column ``features``; rows with a missing vector get NULL."""
        cells = F.when(F.col("features").isNotNull(), vector_to_array("features"))
        if sum(weights.size for weights, _ in self.layers) <= WRITTEN_OUT:
            return self._written_out(df, cells)
        values = F.zip_with(
            F.zip_with(cells, _numbers(self.mean), lambda x, m: x - m), _numbers(self.scale), lambda x, s: x / s
        )
        for number, (weights, bias) in enumerate(self.layers):
            rows = F.array(*[F.struct(_numbers(w).alias("w"), F.lit(float(b)).alias("b")) for w, b in zip(weights, bias)])
            inner = number + 1 < len(self.layers)
            values = _layer(values, rows, inner)
        return df.withColumn("prediction", values[0] * F.lit(self.label_scale) + F.lit(self.label_mean))

    def _written_out(self, df: DataFrame, cells: Column) -> DataFrame:
        out = df.withColumn("_layer", cells)
        sized = F.when(F.size("_layer") == len(self.mean), F.col("_layer"))
        out = out.withColumn("_layer", sized).withColumn(
            "_layer", F.array(*[(F.get("_layer", F.lit(i)) - float(m)) / float(s) for i, (m, s) in enumerate(zip(self.mean, self.scale))])
        )
        for number, (weights, bias) in enumerate(self.layers):
            units = []
            for row, total in zip(weights, bias):
                total = F.lit(float(total))
                for i, w in enumerate(row):
                    total = total + float(w) * F.get("_layer", F.lit(i))
                units.append(F.tanh(total) if number + 1 < len(self.layers) else total)
            out = out.withColumn("_layer", F.array(*units))
        return out.withColumn("prediction", F.get("_layer", F.lit(0)) * F.lit(self.label_scale) + F.lit(self.label_mean)).drop("_layer")


def _layer(values: Column, rows: Column, inner: bool) -> Column:
    def unit(row: Column) -> Column:
        total = F.aggregate(F.zip_with(row["w"], values, lambda w, x: w * x), row["b"], lambda acc, x: acc + x)
        return F.tanh(total) if inner else total

    return F.transform(rows, unit)


def _numbers(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def fit_network_regressor(train: DataFrame, hidden: Sequence[int] = (16,), epochs: int = 50, step: float = 0.05, seed: int = 42, merge: bool = True) -> Fitted:
    """A network from ``features`` and ``label``; ``details['loss']`` has the mean squared error (of scaled labels) per epoch.

    An epoch is one step over all rows. With ``merge`` it goes over rows merged by equal features, which saves time only
    where features repeat; without, over every row. Rows with a missing label or vector, or with values that are no finite
    numbers, are left out; without any other row there is nothing to fit.
    """
    begun = time.monotonic()
    rows = durable(_merged(train) if merge else _packed(train))
    sums = _summed(rows, _moments)
    if sums is None or not sums[0]:
        raise ValueError("No complete row to fit.")
    count, totals = sums[0], sums[1:].reshape(2, -1)
    mean = totals[0] / count
    spread = np.sqrt(np.maximum(totals[1] / count - mean * mean, 0.0))
    scale = np.where(spread > 1e-12, spread, 1.0)
    sizes = [len(mean) - 1, *hidden, 1]
    rng = np.random.default_rng(seed)
    layers = [(rng.normal(0, 1 / math.sqrt(a), (b, a)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]
    first = [[np.zeros_like(p) for p in layer] for layer in layers]
    second = [[np.zeros_like(p) for p in layer] for layer in layers]
    losses: list[float] = []
    for epoch in range(1, epochs + 1):
        found = _summed(rows, _Gradient(layers, mean, scale))
        losses.append(float(found[0] / count))
        at = 1
        for k, layer in enumerate(layers):
            for j, part in enumerate(layer):
                slope = found[at : at + part.size].reshape(part.shape) / count
                at += part.size
                first[k][j] = 0.9 * first[k][j] + 0.1 * slope
                second[k][j] = 0.999 * second[k][j] + 0.001 * slope * slope
                part -= step * (first[k][j] / (1 - 0.9**epoch)) / (np.sqrt(second[k][j] / (1 - 0.999**epoch)) + 1e-8)
    model = Network(layers, mean[:-1], scale[:-1], float(mean[-1]), float(scale[-1]))
    return Fitted(model, "NetworkRegressor", "regression", time.monotonic() - begun, {"loss": losses})


def _merged(train: DataFrame) -> DataFrame:
    """(x, y, n, spread): rows of equal features with their mean label, their number and the squared distances of labels to the mean.

    Rows with a missing label or vector, or with values that are no finite numbers, are left out.
    """
    rows = train.where("label IS NOT NULL AND features IS NOT NULL").select("features", F.col("label").cast("double").alias("y"))
    rows = rows.where(F.abs("y") < math.inf).groupBy("features").agg(
        F.avg("y").alias("y"), F.count(F.lit(1)).cast("double").alias("n"), (F.var_pop("y") * F.count(F.lit(1))).alias("spread")
    )
    return rows.select(vector_to_array("features").alias("x"), "y", "n", "spread")


def _packed(train: DataFrame) -> DataFrame:
    """(width, block): every row's features and label, those of many rows in one block of numbers; no grouping.

    Rows with a missing label or vector, or with values that are no finite numbers, are left out.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            if len(y):
                both = np.column_stack([batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1), y])
                both = both[np.isfinite(both).all(axis=1)]
                if len(both):
                    cells = [pa.array([both.shape[1]], pa.int32()), pa.array([both.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cells, ["width", "block"])

    rows = train.where("label IS NOT NULL AND features IS NOT NULL").select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))
    return spread_rows(rows.mapInArrow(pack, "width int, block binary"))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Features, labels, numbers of rows and spreads, from blocks or from merged rows."""
    if batch.schema.names == ["width", "block"]:
        for width, block in zip(batch.column(0).to_pylist(), batch.column(1)):
            block = np.frombuffer(block.as_buffer()).reshape(-1, width)
            for both in (block[at : at + AT_ONCE] for at in range(0, len(block), AT_ONCE)):
                yield both[:, :-1], both[:, -1], np.ones(len(both)), np.zeros(len(both))
        return
    y, n, spread = (batch.column(k).to_numpy() for k in (1, 2, 3))
    if len(y):
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
        fine = np.isfinite(x).all(axis=1)
        if fine.any():
            yield x[fine], y[fine], n[fine], spread[fine]


def _moments(x: np.ndarray, y: np.ndarray, n: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Count, sums and sums of squares of features and label."""
    both = np.column_stack([x, y])
    squares = n @ (both * both)
    squares[-1] += spread.sum()
    return np.concatenate([[n.sum()], n @ both, squares])


class _Gradient:
    """Loss and gradient of the squared error, summed over rows."""

    def __init__(self, layers: list[Layer], mean: np.ndarray, scale: np.ndarray):
        self.layers, self.mean, self.scale = [(w.copy(), b.copy()) for w, b in layers], mean, scale

    def __call__(self, x: np.ndarray, y: np.ndarray, n: np.ndarray | float = 1.0, spread: np.ndarray | float = 0.0) -> np.ndarray:
        held = [(x - self.mean[:-1]) / self.scale[:-1]]
        for number, (weights, bias) in enumerate(self.layers):
            total = held[-1] @ weights.T + bias
            held.append(np.tanh(total) if number + 1 < len(self.layers) else total)
        miss = held[-1][:, 0] - (y - self.mean[-1]) / self.scale[-1]
        slope, parts = (2 * n * miss)[:, None], []
        for number in range(len(self.layers) - 1, -1, -1):
            weights, _ = self.layers[number]
            parts.append((slope.T @ held[number], slope.sum(axis=0)))
            if number:
                slope = (slope @ weights) * (1 - held[number] ** 2)
        flat = [p.ravel() for layer in reversed(parts) for p in layer]
        return np.concatenate([[float((n * miss) @ miss + np.sum(spread) / self.scale[-1] ** 2)], *flat])


def _summed(rows: DataFrame, measure) -> np.ndarray | None:
    """The sum of ``measure`` over all merged or packed rows: per task, then in a few tasks, then here."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in _parts(batch):
                own = measure(*part)
                total = own if total is None else total + own
        if total is not None:
            yield _row(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for blob in batch.column(0):
                own = np.frombuffer(blob.as_buffer())
                total = own if total is None else total + own
        if total is not None:
            yield _row(total)

    met = rows.mapInArrow(each, "s binary").repartition(MEETING).mapInArrow(add, "s binary").collect()
    return sum(np.frombuffer(r.s) for r in met) if met else None


def _row(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total, np.float64).tobytes()], pa.binary())], ["s"])
