"""Value distributions of many columns at once.

``value_counts`` is the shared first step of distinct counts, modes, exact quantiles and two-sample
tests. A value that fills a third of the table is one row after the map-side combine. Where counts
are used several times they are written once to the shared store. Spark's own
``mode``, ``median`` and ``percentile`` keep every distinct value in one aggregation buffer and
are avoided for that reason.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.values import as_double
from millrace.operators.ordered import running_totals
from millrace.session import durable

# Fixed value: samples up to this size are compared by the exact distribution.
EXACT_UPTO = 10_000


def melt_numeric(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(column, value) rows of the finite numeric values, after the columns ``by``."""
    typed = df.select(*[F.col(f"`{c}`") for c in by], *[as_double(F.col(f"`{c}`"), df.schema[c].dataType).alias(c) for c in columns])
    return typed.unpivot([f"`{c}`" for c in by], list(columns), "column", "value").where(F.col("value").isNotNull())


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return melt_numeric(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """One row with the most frequent value, the smallest on a tie, and its count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col(column).alias("v")))
    return counts.agg(best.alias("b")).select(F.col("b.v").alias("value"), (-F.col("b.k")).alias("n"))


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(column, share, value): linearly interpolated quantiles, exact at any size."""
    counts = running_totals(durable(value_counts(df, columns)), ["column"], ["value"], {"upto": F.col("n")})
    sizes = counts.groupBy("column").agg(F.max("upto").alias("size"))
    ranked = counts.join(sizes, "column").select("column", "value", "size", "upto", (F.col("upto") - F.col("n")).alias("below"))
    parts = []
    for share in shares:
        spot = (F.col("size") - 1) * F.lit(float(share))
        parts += [
            F.max(F.when((F.col("below") <= F.floor(spot)) & (F.floor(spot) < F.col("upto")), F.col("value"))).alias(f"l{share}"),
            F.max(F.when((F.col("below") <= F.ceil(spot)) & (F.ceil(spot) < F.col("upto")), F.col("value"))).alias(f"h{share}"),
            F.max(spot - F.floor(spot)).alias(f"f{share}"),
        ]
    wide = ranked.groupBy("column").agg(*parts)
    rows = F.array(
        *[
            F.struct(
                F.lit(float(s)).alias("share"),
                (F.col(f"`l{s}`") + (F.col(f"`h{s}`") - F.col(f"`l{s}`")) * F.col(f"`f{s}`")).alias("value"),
            )
            for s in shares
        ]
    )
    return wide.select("column", F.explode(rows).alias("r")).select("column", "r.share", "r.value")


def kolmogorov_tail(distance: Column, n_left: Column, n_right: Column) -> Column:
    """Two-sided tail probability of the Kolmogorov distribution.

    The effective sample size carries Stephens' small-sample correction. The alternating series is
    summed over 100 terms; below 0.2 it converges slowly and the probability is 1.
    """
    size = F.sqrt(n_left.cast("double") * n_right / (n_left + n_right))
    lam = (size + F.lit(0.12) + F.lit(0.11) / size) * distance
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(F.lit(-2.0) * k * k * lam * lam),
    )
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def exact_tail(distance: float, n: int, m: int) -> float:
    """Probability that two samples of ``n`` and ``m`` values of one continuous distribution lie ``distance`` or more apart.

    The merged order of both samples is a lattice path from (0, 0) to (n, m), all paths equally likely. The path is
    walked as a chain: ``inside`` holds the chance to stand at each i without having been too far apart, and what
    steps over the border is summed, so small probabilities keep their digits.
    """
    far = round(distance * n * m)  # |i * m - j * n| is a whole number
    if far <= 0:
        return 1.0
    low, inside, outside = 0, np.ones(1), 0.0
    for step in range(n + m):
        at = np.arange(low, low + len(inside))
        # Products of whole numbers come first: shares like 1 / 20 keep their last digit and are not taken for less.
        nxt = np.zeros(len(inside) + 1)
        nxt[:-1] = inside * (m - step + at) / (n + m - step)
        nxt[1:] += inside * (n - at) / (n + m - step)
        at = np.arange(low, low + len(nxt))
        kept = np.abs(at * m - (step + 1 - at) * n) < far
        outside += float(nxt[~kept].sum())
        if not kept.any():
            break
        first, last = int(kept.argmax()), len(kept) - int(kept[::-1].argmax())
        low, inside = low + first, nxt[first:last]
    return min(1.0, outside)


def two_sample_tail(distance: Column, n_left: Column, n_right: Column, exact_upto: int = EXACT_UPTO) -> Column:
    """p-value of the distance: exact while both samples have at most ``exact_upto`` values, asymptotic beyond."""

    def exact(distances: pd.Series, lefts: pd.Series, rights: pd.Series) -> pd.Series:
        found = [exact_tail(d, int(n), int(m)) if max(n, m) <= exact_upto else None for d, n, m in zip(distances, lefts, rights)]
        return pd.Series(found, dtype="float64")

    if exact_upto <= 0:
        return kolmogorov_tail(distance, n_left, n_right)
    # One short row for each comparison reaches Python.
    small = F.pandas_udf(exact, "double")(distance, n_left, n_right)
    return F.when(F.greatest(n_left, n_right) <= exact_upto, small).otherwise(kolmogorov_tail(distance, n_left, n_right))


def two_sample_distance(reference: DataFrame, current: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, n_reference, n_current, distance): largest gap of the two empirical distributions.

    With ``by`` each group is compared on its own; groups with a missing key and columns without values on either
    side are left out.
    """
    keys = [*by, "column"]
    whole = [F.col(f"`{c}`").isNotNull() for c in by]
    melted = melt_numeric(reference, columns, by).withColumn("side", F.lit(0)).unionByName(melt_numeric(current, columns, by).withColumn("side", F.lit(1)))
    for known in whole:
        melted = melted.where(known)
    both = durable(
        melted.groupBy(*keys, "value").agg(F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("c"))
    )
    steps = running_totals(both, keys, ["value"], {"upto_r": F.col("r"), "upto_c": F.col("c")})
    sizes = both.groupBy(*keys).agg(F.sum("r").alias("n_reference"), F.sum("c").alias("n_current"))
    gap = F.abs(F.col("upto_r") / F.col("n_reference") - F.col("upto_c") / F.col("n_current"))
    return (
        steps.join(sizes.where("n_reference > 0 AND n_current > 0"), keys)
        .groupBy(*keys, "n_reference", "n_current")
        .agg(F.max(gap).alias("distance"))
    )
