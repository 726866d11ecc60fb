"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine at least c differ by at most 2 - 2c in squared distance. Rotated by a fixed
orthogonal matrix and cut into blocks, at least one block then differs by no more than its equal share of that
budget. Every block is joined by range: its first two coordinates name a grid cell as wide as the block's
radius, and a vector meets the vectors of its own and the neighbouring cells. Candidates within the
block's budget are verified in double precision. A pair is counted only in the first block within
budget, so it counts once although several blocks may find it.

Equal vectors form a class and one of them goes on with the size of the class. A cell with many vectors is
dealt as pairs of chunks to several tasks. Tasks return, per vector, the count of its links and one link to
the smallest vector it hangs together with, never pairs; the output follows the number of vectors.

Defined results: vectors link with vectors of their own length only, whatever lengths the table holds. Vectors that
are NULL, zero, or hold NULL or non-finite components link with nothing, nor do those whose label is NULL. Rows with one vec_id and label and equal vectors
are members of their class each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.components import connected_components
from millrace.llm.tables import saved

BLOCKS = 8
CHUNK = 2048
TILE = 256
ROUNDING = 1e-9


@lru_cache(maxsize=4)
def rotation(size: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(20).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def block_edges(size: int, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    blocks = max(1, min(blocks, size // 2))
    cuts = [size * k // blocks for k in range(blocks + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; by the largest component first, so squares cannot overflow."""
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return unit_rows(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size))


def _components(vectors: DataFrame, vector: str) -> Column:
    """The vector column, as it is if it holds floats or doubles."""
    kind = vectors.schema[vector].dataType.simpleString()
    return F.col(f"`{vector}`") if kind in ("array<float>", "array<double>") else F.col(f"`{vector}`").cast("array<double>")


def classes_of(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(label, v, id, n, w): distinct usable vectors, their smallest id, how many there are of each and their length."""
    named = vectors.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{label}`").alias("label"), _components(vectors, vector).alias("v"))
    usable = named.where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    return usable.groupBy("label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("w", F.size("v"))


def cells(classes: DataFrame, budget: float) -> DataFrame:
    """(label, w, cell, home, id, n): every vector in its own and four neighbouring cells of every block.

    Of two cells side by side only one is asked for the other, so each pair of cells meets once.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(4).to_numpy()
            for size in np.unique(widths).tolist():
                alike = batch.filter(pa.array(widths == size))
                for start in range(0, alike.num_rows, 512):
                    yield from _cells_of(alike.slice(start, 512), size, budget)

    kind = classes.schema["label"].dataType.simpleString()
    return classes.select("label", "id", "n", "v", "w").mapInArrow(work, f"label {kind}, w int, cell long, home boolean, id long, n long")


def _cells_of(part: pa.RecordBatch, size: int, budget: float) -> Iterator[pa.RecordBatch]:
    edges = block_edges(size)
    radius = float(np.sqrt(budget / len(edges))) * (1 + 1e-6) + 1e-12
    turned = _matrix(part.column(3), size) @ rotation(size)
    for block, (a, b) in enumerate(edges):
        grid = np.floor(turned[:, a : min(a + 2, b)] / radius).astype(np.int64)
        grid = np.column_stack([grid, np.zeros((len(grid), 2 - grid.shape[1]), np.int64)])
        for dx, dy in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1)):
            names = ((block * (1 << 28)) + (grid[:, 0] + dx + (1 << 13)) * (1 << 14) + (grid[:, 1] + dy + (1 << 13))).astype(np.int64)
            home = pa.array(np.full(len(names), dx == 0 and dy == 0))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(4), pa.array(names), home, part.column(1), part.column(2)], ["label", "w", "cell", "home", "id", "n"]
            )


def dealt_cells(rows: DataFrame, chunk: int) -> DataFrame:
    """Adds chunk numbers: rows of a large cell are dealt to tasks as pairs of chunks.

    Home rows take the left side with their chunk against every right chunk; all rows take the right side.
    """
    sizes = rows.groupBy("label", "w", "cell").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("home")).alias("homes")).where("homes > 0 AND rows > 1")
    cut = rows.join(sizes, ["label", "w", "cell"])
    lefts = F.ceil(F.col("homes") / F.lit(float(chunk))).cast("int")
    rights = F.ceil(F.col("rows") / F.lit(float(chunk))).cast("int")
    own = F.xxhash64("id")
    left = cut.where("home").select(
        "label", "w", "cell", F.pmod(own, lefts).cast("int").alias("l"), F.explode(F.sequence(F.lit(0), rights - 1)).alias("r"), F.lit(True).alias("left"), "home", "id", "n"
    )
    right = cut.select(
        "label", "w", "cell", F.explode(F.sequence(F.lit(0), lefts - 1)).alias("l"), F.pmod(own, rights).cast("int").alias("r"), F.lit(False).alias("left"), "home", "id", "n"
    )
    return left.union(right)


def _links_of_task(group: pa.Table, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, counts, smallest linked id) of one pair of chunks in one cell."""
    size = group["w"][0].as_py()
    edges, turn = block_edges(size), rotation(size)
    share = (2 - 2 * limit) / len(edges) + ROUNDING
    block = group["cell"][0].as_py() >> 28
    a, b = edges[block]
    side = group["left"].to_numpy()
    if side.all() or not side.any():
        return (np.zeros(0, np.int64),) * 3
    id_, n, unit = group["id"].to_numpy(), group["n"].to_numpy(), _matrix(group["v"].combine_chunks(), size)
    lid, rid, ln, rn, lu, ru = id_[side], id_[~side], n[side], n[~side], unit[side], unit[~side]
    home = group["home"].to_numpy()[~side]
    lt, rt = lu @ turn, ru @ turn
    ids, at = np.unique(np.concatenate([lid, rid]), return_inverse=True)
    la, ra = at[: len(lid)], at[len(lid) :]
    counts, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    linked = np.zeros(len(ids), bool)
    for start in range(0, len(lid), TILE):
        own = slice(start, start + TILE)
        x, y = lt[own, a:b], rt[:, a:b]
        near = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T) <= share + ROUNDING
        # Two home vectors meet in both orders: only the smaller id asks. Visitors are asked by every home vector.
        near &= np.where(home[None, :], lid[own][:, None] < rid[None, :], True)
        i, j = np.nonzero(near)
        for part in range(0, len(i), 1 << 15):
            p, q = i[part : part + (1 << 15)] + start, j[part : part + (1 << 15)]
            good = (lu[p] * ru[q]).sum(1) >= limit
            p, q = p[good], q[good]
            if not len(p):
                continue
            gap = (lt[p] - rt[q]) ** 2
            earlier = np.zeros(len(p), bool)
            for k in range(block):
                earlier |= gap[:, edges[k][0] : edges[k][1]].sum(1) <= share
            within = gap[:, a:b].sum(1) <= share
            fresh = within & ~earlier
            np.add.at(counts, la[p[fresh]], rn[q[fresh]])
            np.add.at(counts, ra[q[fresh]], ln[p[fresh]])
            s, t = la[p], ra[q]
            linked[s] = linked[t] = True
            while True:  # smallest id of what hangs together
                low = np.minimum(root[s], root[t])
                if (root[s] == low).all() and (root[t] == low).all():
                    break
                np.minimum.at(root, root[s], low)
                np.minimum.at(root, root[t], low)
                np.minimum.at(root, s, low)
                np.minimum.at(root, t, low)
                root = root[root]
    while (root[root] != root).any():
        root = root[root]
    some = np.flatnonzero(linked)
    return ids[some], counts[some], ids[root[some]]


def block_links(dealt: DataFrame, classes: DataFrame, limit: float) -> DataFrame:
    """(id, links, root) from every task; links of one vector are to be added up."""
    keys = ["label", "w", "cell", "l", "r"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            *whole, rest = _runs(rest)
            for group in whole:  # the last run may go on in the next batch; a run is at most two chunks
                yield _result(_links_of_task(group, limit))
        if rest is not None and rest.num_rows:
            yield _result(_links_of_task(rest, limit))

    bodies = classes.select("label", "w", "id", "v")
    ordered = dealt.join(bodies, ["label", "w", "id"]).repartition(*keys).sortWithinPartitions(*keys, "left", "id")
    return ordered.select(*keys, "left", "home", "id", "n", "v").mapInArrow(work, "id long, links long, root long")


def _runs(table: pa.Table) -> list[pa.Table]:
    """Rows of one cell and pair of chunks, in order."""
    rows = table.num_rows
    if not rows:
        return [table]
    new = np.zeros(rows, bool)
    for name in ("label", "w", "cell", "l", "r"):
        codes = table[name].combine_chunks().dictionary_encode().indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    cuts = [0, *np.flatnonzero(new).tolist(), rows]
    return [table.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:])]


def _result(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["id", "links", "root"])


def linked_vectors(vectors: DataFrame, limit: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``vectors``."""
    classes = saved(classes_of(vectors, key, vector, label), "vector-classes")
    rows = saved(cells(classes, 2 - 2 * limit), "vector-cells")
    found = saved(block_links(dealt_cells(rows, chunk), classes, limit), "vector-links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("id != root").select(F.col("root").alias("a"), F.col("id").alias("b")))
    placed = classes.join(counts, "id", "left").join(parts, "id", "left").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("_links"), F.coalesce("component", "id").alias("_c")
    )
    named = vectors.select(F.col(f"`{key}`").cast("bigint").alias("vec_id"), F.col(f"`{label}`").alias("label"), _components(vectors, vector).alias("v"))
    return named.join(placed, ["label", "v"], "left").select(
        "vec_id", F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("_c", "vec_id").alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
