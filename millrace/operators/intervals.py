"""Joins of intervals that overlap, as equality joins over a tree of bins.

Two closed intervals overlap if one starts inside the other: the right one at or after the left one's start,
or the left one strictly after the right one's. Each half is a join of points with intervals. Starts are cut into
leaves of about equal row counts. An interval becomes the few tree nodes that cover its whole leaves, and its two end
leaves, which are compared exactly; a point belongs to its leaf and the nodes above it. A pair meets in one node
only, so no pair needs to be removed again, and an interval of any length has at most two nodes per level.

The tree is for keys of many rows, and for joins without keys. The rows of a key that has few are compared directly in an
equality join of the key: every row is sent once, where the tree would send it for each of its nodes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.ordered import default_ranges, range_cuts, range_number

#: Points of one node that meet in a task; a node with more is divided.
NODE_POINTS = 100_000
#: Rows of a key, both sides together, that are compared without the tree.
FEW_ROWS = 1_000
_EDGE = -1


def overlap_join(
    left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], keys: Sequence[str] = (),
    leaves: int | None = None, node_points: int = NODE_POINTS, few_rows: int = FEW_ROWS,
) -> DataFrame:
    """All pairs of rows with equal ``keys`` whose closed intervals share a point, with the columns of both sides.

    Column names other than ``keys`` must differ between the sides. Rows with a missing key, start or end, or with an
    end before the start, meet nothing.
    """
    clash = {c.lower() for c in left.columns if c not in keys} & {c.lower() for c in right.columns}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    sides = []
    for df, (start, end) in ((left, left_span), (right, right_span)):
        whole = df.where(F.col(f"`{start}`") <= F.col(f"`{end}`"))
        for key in keys:
            whole = whole.where(F.col(f"`{key}`").isNotNull())
        sides.append(whole.select(*[F.col(f"`{k}`") for k in keys], F.struct(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(c for c in df.columns if c not in keys)]).alias("_row"),
                                  F.col(f"`{start}`").alias("_from"), F.col(f"`{end}`").alias("_to")))
    a, b = sides
    # Cells go by their place, so that Spark sends a table that is joined with itself only once.
    columns = [*keys, *[F.col(f"{side}._{i}").alias(c) for side, df in (("_l", left), ("_r", right)) for i, c in enumerate(c for c in df.columns if c not in keys)]]
    if not keys:
        return _tree_pairs(a, b, leaves or 4 * default_ranges(left), keys, node_points).select(*columns)
    many = a.select(*keys).unionAll(b.select(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > few_rows).drop("_n")
    some = not many.isEmpty()
    # At most one row for each ``few_rows`` rows of the sides.
    apart = [df.join(F.broadcast(many), list(keys), "left_anti") if some else df for df in (a, b)]
    first, second = (df.withColumnsRenamed({"_row": side, "_from": f"_from{side}", "_to": f"_to{side}"}) for df, side in zip(apart, ("_l", "_r")))
    pairs = first.join(second, list(keys)).where("_from_l <= _to_r AND _from_r <= _to_l").select(*columns)
    if not some:
        return pairs
    a, b = (df.join(F.broadcast(many), list(keys), "left_semi") for df in (a, b))
    return pairs.unionAll(_tree_pairs(a, b, leaves or 4 * default_ranges(left), keys, node_points).select(*columns))


def _tree_pairs(a: DataFrame, b: DataFrame, leaves: int, keys: Sequence[str], node_points: int) -> DataFrame:
    """(keys, _l, _r) of all pairs, met in the nodes of the tree."""
    cuts = range_cuts(a.select("_from").unionAll(b.select("_from")), [], ["_from"], leaves)
    later = _starts_inside(b, a, cuts, keys, F.col("_point") >= F.col("_from"), node_points)
    earlier = _starts_inside(a, b, cuts, keys, F.col("_point") > F.col("_from"), node_points)
    return later.select(*keys, F.col("_row").alias("_l"), F.col("_other").alias("_r")).unionAll(
        earlier.select(*keys, F.col("_other").alias("_l"), F.col("_row").alias("_r"))
    )


def _starts_inside(points: DataFrame, spans: DataFrame, cuts: list[tuple], keys: Sequence[str], begun: Column, node_points: int) -> DataFrame:
    """(keys, _row of the interval, _other of the point) for starts of ``points`` that lie in ``spans``."""
    depth = max(1, len(cuts).bit_length() + 1)
    leaf = _number(points, "_from", cuts)
    placed = points.select(*keys, F.col("_row").alias("_other"), F.col("_from").alias("_point"), F.explode(F.array(leaf)).alias("_leaf"))
    nodes = F.explode(F.concat(
        F.array(_node(F.lit(_EDGE), F.col("_leaf"))),
        F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda k: _node(k, F.call_function("shiftright", F.col("_leaf"), k))),
    ))
    low, high = _number(spans, "_from", cuts), _number(spans.select(F.col("_to").alias("_from")), "_from", cuts, "_to")
    covered = spans.select("*", F.explode(F.array(F.struct(low.alias("a"), high.alias("z")))).alias("_l"))
    covered = covered.select(*keys, "_row", "_from", "_to", F.explode(_cover(F.col("_l.a"), F.col("_l.z"), depth)).alias("_node"))
    placed = placed.select(*keys, "_other", "_point", nodes.alias("_node"))
    # Only nodes that some interval covers are joined; their number is at most twice that of the leaves.
    used = covered.select("_node").distinct()
    counts = placed.select("_node").join(F.broadcast(used), "_node", "left_semi").groupBy("_node").agg(F.count(F.lit(1)).alias("_n"))
    parts = counts.select("_node", F.ceil(F.col("_n") / node_points).cast("int").alias("_parts"))
    dealt = placed.join(F.broadcast(parts), "_node").withColumn("_part", F.pmod(F.xxhash64("_other", "_point"), F.col("_parts")).cast("int")).drop("_parts")
    met = covered.join(F.broadcast(parts), "_node").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    # Starts in leaves that an interval covers whole lie inside it; in its end leaves the ends decide.
    inside = (F.col("_node.k") != _EDGE) | (begun & (F.col("_point") <= F.col("_to")))
    return met.hint("merge").join(dealt, [*keys, "_node", "_part"]).where(inside).select(*keys, "_row", "_other")


def _number(df: DataFrame, column: str, cuts: list[tuple], name: str | None = None) -> Column:
    """Leaf of a value; ``name`` is the column to read if it is another than that of the frame."""
    found = range_number(df, [column], cuts)
    if name is None or not cuts:
        return found.cast("int")
    points = F.array(*[F.lit(c[0]).cast(df.schema[column].dataType) for c in cuts])
    return F.size(F.filter(points, lambda x: x <= F.col(name))).cast("int")


def _node(level, number) -> Column:
    return F.struct(level.cast("int").alias("k"), number.cast("int").alias("i"))


def _cover(first: Column, last: Column, depth: int) -> Column:
    """The end leaves as edges, and the largest nodes that cover the leaves between them."""
    edges = F.when(first == last, F.array(_node(F.lit(_EDGE), first))).otherwise(F.array(_node(F.lit(_EDGE), first), _node(F.lit(_EDGE), last)))

    def level(k):
        size = F.call_function("shiftleft", F.lit(1), k)
        low = F.floor((first + size) / size)  # the first node that starts behind the first leaf
        high = F.floor(last / size)  # the node behind the last one that ends before the last leaf
        left = F.when((low < high) & (low % 2 == 1), _node(k, low))
        right = F.when((low < high) & (high % 2 == 1), _node(k, high - 1))
        return F.array(left, right)

    inner = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(depth)), level)), lambda n: n.isNotNull())
    return F.concat(edges, F.array_distinct(inner))
