"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.llm.tables import saved


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, component) for every id in ``links``; the component is its smallest id.

    Every round points each neighbour at the smallest id around it, first to the larger side, then to the
    smaller. Rounds work on link tables of at most the size of the input, are written to the shared folder,
    and end when nothing changes; a star needs one round. No component is gathered anywhere.
    """
    edges = saved(
        links.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).where("a < b").distinct(), "links"
    )
    mark = _mark(edges)
    while mark[0]:
        large = _large_star(edges)
        edges = saved(_small_star(large), "links")
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).union(
        edges.select(F.col("a").alias("id"), F.col("a").alias("component"))
    ).groupBy("id").agg(F.min("component").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free check sum: two link tables with equal marks are equal."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
    return (row[0], row[1], row[2])


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each id are linked to the smallest id in its neighbourhood."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
    smallest = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
    # u > v is the link (v, u) itself: only one direction of the table is needed here.
    return edges.withColumnsRenamed({"a": "v", "b": "u"}).join(smallest, "v").select(F.col("m").alias("a"), F.col("u").alias("b")).where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each id and its smaller neighbours are linked to the smallest of them."""
    smallest = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(smallest, "b")
    return joined.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b").union(
        smallest.select(F.col("m").alias("a"), "b")
    ).distinct()
