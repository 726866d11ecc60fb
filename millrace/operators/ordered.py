"""Running totals, positions and carried values over long groups.

A plain ordered window sends a whole group to one task. Here the order key is first cut into value
ranges. Every range of every group is worked on by its own task, and a small table of range totals
supplies what came before. One group may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window

MIN_RANGES, SAMPLES_PER_RANGE = 8, 20


def default_ranges(df: DataFrame) -> int:
    """As many value ranges as the session has shuffle partitions, eight at least."""
    return max(MIN_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def range_cuts(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int) -> list[tuple]:
    """Whole order tuples that cut the table into about equal ranges.

    They come from ``SAMPLES_PER_RANGE`` rows for each range, drawn by a hash of the row's number and order
    tuple, so a tuple counts by the rows that share it. Cuts balance the work and never change a result.
    """
    names = [f"`{c}`" for c in order]
    drawn = F.xxhash64(F.monotonically_increasing_id(), *names)
    chosen = df.select(*names, drawn.alias("_draw")).orderBy("_draw").limit(ranges * SAMPLES_PER_RANGE)
    rows = [tuple(r) for r in chosen.select(*names).orderBy(*names).collect()]
    cuts = [rows[len(rows) * i // ranges] for i in range(1, ranges) if rows]
    return [cut for i, cut in enumerate(cuts) if not i or cut != cuts[i - 1]]


def range_number(df: DataFrame, order: Sequence[str], cuts: Sequence[tuple]) -> Column:
    """How many cuts are not above the row's order tuple: a binary search in the array of cuts."""
    if not cuts:
        return F.lit(0)
    types = [df.schema[c].dataType for c in order]
    names = [f"_{i}" for i in range(len(order))]
    points = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(cut, types, names)]) for cut in cuts])
    own = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(order, names)])
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, step: F.when(F.coalesce(F.get(points, at + step - 1) <= own, F.lit(False)), at + step).otherwise(at),
    )


def _spread(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None) -> DataFrame:
    number = range_number(df, order, range_cuts(df, keys, order, ranges or default_ranges(df)))
    # Exploded, so that grouping by the number never repeats its lambda expression.
    return df.select("*", F.explode(F.array(number)).alias("_range"))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, Column],
    ranges: int | None = None,
) -> DataFrame:
    """Inclusive running sum of each measure in ``order`` within ``keys``; adds the named columns.

    ``order`` must be unique within a group, keys must not be NULL.
    """
    tagged = _spread(df, keys, order, ranges).withColumns({f"_m_{n}": c for n, c in totals.items()})
    sums = tagged.groupBy(*keys, "_range").agg(*[F.sum(f"_m_{n}").alias(f"_s_{n}") for n in totals])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys, "_range", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals]
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = tagged.withColumns({f"_i_{n}": F.sum(f"_m_{n}").over(inside) for n in totals}).join(
        offsets, [*keys, "_range"]
    )
    return joined.select(*df.columns, *[(F.col(f"_o_{n}") + F.col(f"_i_{n}")).alias(n) for n in totals])


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position", ranges: int | None = None
) -> DataFrame:
    """Adds the 1-based position of each row in ``order`` within ``keys`` (global if none)."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("bigint")}, ranges)


def running_extreme(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, largest: bool = True,
    ranges: int | None = None,
) -> DataFrame:
    """Adds the best ``value`` seen so far in ``order`` within ``keys``."""
    best = F.max if largest else F.min
    tagged = _spread(df, keys, order, ranges).withColumn("_v", value)
    tops = tagged.groupBy(*keys, "_range").agg(best("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tops.select(*keys, "_range", best("_t").over(before).alias("_before"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = tagged.withColumn("_in", best("_v").over(inside)).join(offsets, [*keys, "_range"])
    pick = F.greatest if largest else F.least
    return joined.select(*df.columns, pick("_before", "_in").alias(name))


def carry_last(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, ranges: int | None = None
) -> DataFrame:
    """Adds the last non-NULL ``value`` at or before each row in ``order`` within ``keys``."""
    tagged = _spread(df, keys, order, ranges)
    known = tagged.where(F.col(value).isNotNull())
    lasts = tagged.select(*keys, "_range").distinct().join(
        known.groupBy(*keys, "_range").agg(F.max_by(value, F.struct(*order)).alias("_last")), [*keys, "_range"], "left"
    )
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lasts.select(*keys, "_range", F.last("_last", ignorenulls=True).over(before).alias("_before"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = tagged.withColumn("_in", F.last(value, ignorenulls=True).over(inside)).join(offsets, [*keys, "_range"])
    return joined.select(*df.columns, F.coalesce("_in", "_before").alias(name))
