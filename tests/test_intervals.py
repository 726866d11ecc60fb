"""Overlap join against all pairs on small tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.intervals import _cover, overlap_join


def pairs(left, right, keyed):
    return sorted(
        (a[0], b[0]) for a in left for b in right
        if None not in (a[2], a[3], b[2], b[3]) and a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and b[2] <= a[3] and (not keyed or (a[1] is not None and a[1] == b[1]))
    )


@pytest.mark.parametrize(("keyed", "leaves", "node_points"), [(False, 5, 3), (True, None, 100_000), (False, 64, 100_000), (True, 2, 2)])
def test_all_pairs(spark, keyed, leaves, node_points):
    rng = random.Random(4)

    def rows(count):
        out = []
        for i in range(count):
            start = rng.randint(0, 60)
            out.append((i, rng.choice(["a", "b", None]), start, start + rng.choice([-2, 0, 0, 1, 5, 70])))
        return out + [(900, "a", None, 5), (901, "a", 5, None), (902, "b", -1000, 1000), (903, "a", 7, 7), (903, "a", 7, 7)]

    left, right = rows(120), rows(90)
    a = spark.createDataFrame(left, "i int, g string, s int, e int").repartition(3)
    b = spark.createDataFrame(right, "j int, g string, u int, v int").repartition(4)
    keys = ["g"] if keyed else []
    if not keyed:
        b = b.withColumnRenamed("g", "h")
    got = overlap_join(a, b, ("s", "e"), ("u", "v"), keys, leaves, node_points)
    assert sorted((r.i, r.j) for r in got.collect()) == pairs(left, right, keyed)


def test_cover_is_exact(spark):
    """Edges and nodes of an interval name each leaf between its ends once."""
    df = spark.range(0, 40).crossJoin(spark.range(0, 40).withColumnRenamed("id", "z")).where("id <= z")
    for r in df.select("id", "z", _cover(F.col("id").cast("int"), F.col("z").cast("int"), 7).alias("c")).collect():
        leaves = [leaf for n in r.c for leaf in ([n.i] if n.k < 0 else range(n.i << n.k, (n.i + 1) << n.k))]
        assert sorted(leaves) == list(range(r.id, r.z + 1)) and len(r.c) <= 2 + 2 * 7


def test_one_moment_holds_most_rows(spark):
    """A hot node is divided: no nested loop in the plan, and every pair is there."""
    many = spark.range(400).select(F.col("id").alias("i"), F.lit(10).alias("s"), F.lit(10).alias("e"))
    few = spark.range(30).select(F.col("id").alias("j"), (F.col("id") - 15 + 10).cast("int").alias("u"), (F.col("id") + 10).cast("int").alias("v"))
    joined = overlap_join(many, few, ("s", "e"), ("u", "v"), node_points=20)
    plan = joined._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin" in plan
    assert joined.count() == 400 * sum(j - 5 <= 10 <= j + 10 for j in range(30))


def test_empty_and_clashing(spark):
    a = spark.createDataFrame([], "i int, s int, e int")
    b = spark.createDataFrame([(1, 2, 3)], "j int, u int, v int")
    assert overlap_join(a, b, ("s", "e"), ("u", "v")).collect() == [] == overlap_join(b, a, ("u", "v"), ("s", "e")).collect()
    with pytest.raises(ValueError, match="both sides"):
        overlap_join(a, a, ("s", "e"), ("s", "e"))


@pytest.mark.parametrize("few_rows", [0, 30, 1_000])
def test_keys_of_few_and_many_rows(spark, few_rows):
    """Keys on both sides of the bound give the same pairs as all pairs."""
    rng = random.Random(9)

    def rows(count):
        starts = [(i, rng.choice("aaaaabcdefgh"), rng.randint(0, 40)) for i in range(count)]
        return [(i, g, s, s + rng.choice([-1, 0, 3, 50])) for i, g, s in starts] + [(900, None, 1, 2), (901, "h", None, 5)]

    left, right = rows(90), rows(110)
    a, b = spark.createDataFrame(left, "i int, g string, s int, e int"), spark.createDataFrame(right, "j int, g string, u int, v int")
    got = overlap_join(a, b, ("s", "e"), ("u", "v"), ["g"], few_rows=few_rows, node_points=7)
    assert got.columns == ["g", "i", "s", "e", "j", "u", "v"]
    assert sorted((r.i, r.j) for r in got.collect()) == pairs(left, right, True)


def test_rows_of_small_keys_are_sent_once(spark):
    """Long intervals of many small keys: no row is repeated for nodes of a tree."""
    df = spark.range(4000).select((F.col("id") % 400).alias("k"), F.col("id").alias("i"), F.lit(0).alias("s"), (F.col("id") + 1).cast("int").alias("e"))
    joined = overlap_join(df, df.withColumnsRenamed({"i": "j", "s": "u", "e": "v"}), ("s", "e"), ("u", "v"), ["k"])
    assert "Generate" not in joined._jdf.queryExecution().toString()
    assert joined.count() == 400 * 10 * 10
