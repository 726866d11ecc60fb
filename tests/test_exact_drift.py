"""Exact two-sample p-values against path counts in whole numbers and closed forms."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from millrace.operators import drift as D
from millrace.operators.distribution import exact_tail, kolmogorov_tail, two_sample_tail


def counted(far: int, n: int, m: int) -> Fraction:
    """Share of the lattice paths that touch |i * m - j * n| >= far, counted one by one."""
    ways = {}
    for i in range(n + 1):
        for j in range(m + 1):
            inside = abs(i * m - j * n) < far
            ways[i, j] = (1 if i == j == 0 else ways.get((i - 1, j), 0) + ways.get((i, j - 1), 0)) if inside else 0
    return 1 - Fraction(ways[n, m], math.comb(n + m, n))


@pytest.mark.parametrize("n", [5, 6, 10, 17, 20, 35, 50])
def test_equal_sizes_against_the_closed_form(n):
    for h in range(1, n + 1):
        whole = 2 * sum((-1) ** (k - 1) * math.comb(2 * n, n - k * h) for k in range(1, n // h + 1))
        assert exact_tail(h / n, n, n) == pytest.approx(float(Fraction(whole, math.comb(2 * n, n))), rel=1e-9)


@pytest.mark.parametrize(("n", "m"), [(1, 1), (3, 7), (5, 6), (8, 20), (17, 50), (50, 49), (30, 45)])
def test_unequal_sizes_against_path_counts(n, m):
    for far in sorted({abs(i * m - j * n) for i in range(n + 1) for j in range(m + 1)} - {0})[:: max(1, n * m // 60)]:
        assert exact_tail(far / (n * m), n, m) == pytest.approx(float(counted(far, n, m)), rel=1e-9)


def test_published_values():
    """Table values of the two-sided test: 5 and 5, 10 and 10, 4 and 6."""
    assert round(exact_tail(0.8, 5, 5), 5) == 0.07937 and round(exact_tail(1.0, 5, 5), 5) == 0.00794
    assert round(exact_tail(0.6, 10, 10), 5) == 0.05245 and round(exact_tail(0.7, 10, 10), 5) == 0.01234
    assert round(exact_tail(1.0, 4, 6), 5) == round(2 / math.comb(10, 4), 5)
    assert exact_tail(0.0, 4, 6) == 1.0


def test_small_probabilities_keep_their_digits():
    assert exact_tail(1.0, 40, 40) == pytest.approx(2 / math.comb(80, 40), rel=1e-9)


def test_switch_to_the_asymptotic_form(spark):
    row = spark.createDataFrame([(0.05, 900, 1100)], "d double, n long, m long")
    cols = [F.col(c) for c in ("d", "n", "m")]
    exact, far, none = row.select(two_sample_tail(*cols), two_sample_tail(*cols, exact_upto=1000), two_sample_tail(*cols, exact_upto=0)).first()
    assert far == none == row.select(kolmogorov_tail(*cols)).first()[0] != exact
    assert abs(exact - far) < 0.01


def test_small_samples_decide_exactly(spark):
    """Distance 0.6 of ten and ten values: p is 0.052, no drift; the asymptotic form would report one."""
    left = spark.createDataFrame([(float(v), "a") for v in range(10)] + [(None, "a"), (1.0, None)], "x double, g string")
    right = spark.createDataFrame([(v + 5.5, "a") for v in range(10)] + [(9.0, None)], "x double, g string")
    row = D.feature_drift(left.where("g = 'a'"), right.where("g = 'a'")).first()
    assert (row.n_reference, row.n_current, row.drifted) == (10, 10, False) and round(row.p_value, 5) == 0.05245
    assert D.feature_drift(left.where("g = 'a'"), right.where("g = 'a'"), exact_upto=0).first().drifted
    grouped = D.feature_drift(left, right, by=["g"]).collect()
    assert [(r.g, r.column, round(r.p_value, 5)) for r in grouped] == [("a", "x", 0.05245)]


def test_groups_of_many_sizes(spark):
    rng = random.Random(2)
    rows = [(g, side, float(rng.randrange(6))) for g in range(12) for side in (0, 1) for _ in range(rng.randint(0 if side else 1, 9))]
    df = spark.createDataFrame(rows, "g int, side int, x double")
    got = {r.g: r for r in D.feature_drift(df.where("side = 0").drop("side"), df.where("side = 1").drop("side"), by=["g"]).collect()}
    for g in range(12):
        a, b = ([x for k, s, x in rows if k == g and s == side] for side in (0, 1))
        if not a or not b:
            assert g not in got
            continue
        far = max(abs(sum(x <= v for x in a) * len(b) - sum(x <= v for x in b) * len(a)) for v in range(6))
        want = 1.0 if not far else float(counted(far, len(a), len(b)))
        assert got[g].p_value == pytest.approx(want, rel=1e-9) and (got[g].n_reference, got[g].n_current) == (len(a), len(b))


@pytest.mark.parametrize(("n", "m", "far"), [(14, 2, 26), (2, 14, 26)])
def test_probability_at_the_threshold_is_no_drift(spark, n, m, far):
    """Six of 120 paths: the probability is 0.05 to the last digit, which is not below 0.05."""
    assert counted(far, n, m) == Fraction(1, 20) and exact_tail(far / (n * m), n, m) == 0.05
    many, few = [float(v) for v in range(14)], [12.5, 13.5]
    left, right = (many, few) if n > m else (few, many)
    row = D.feature_drift(spark.createDataFrame([(v,) for v in left], "x double"), spark.createDataFrame([(v,) for v in right], "x double")).first()
    assert round(row.distance * n * m) == far and row.p_value == 0.05 and not row.drifted
