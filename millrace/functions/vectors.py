"""Column expressions over array<double> vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def unit(col: Column) -> Column:
    """Unit length; a zero vector stays zero.

    The outer one-element transform binds the norm, which would otherwise be computed per element.
    """
    norm = F.sqrt(F.aggregate(col, F.lit(0.0), lambda acc, x: acc + x * x))
    scaled = F.transform(F.array(F.when(norm == 0, F.lit(1.0)).otherwise(norm)), lambda n: F.transform(col, lambda x: x / n))
    return F.element_at(scaled, 1)


def cosine(left: Column, right: Column) -> Column:
    """Dot product of the two directions; 0 if either vector is zero."""
    length = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.coalesce(dot(left, right) / F.nullif(length, F.lit(0.0)), F.lit(0.0))


def terms(col: Column) -> Column:
    """Lower-case runs of letters and digits, the word ``empty`` if there are none.

    May hold empty strings at the ends, to be filtered after exploding.
    """
    lowered = F.lower(F.coalesce(col, F.lit("")))
    return F.split(F.when(lowered.rlike(r"[\p{L}\p{N}]"), lowered).otherwise(F.lit("empty")), r"[^\p{L}\p{N}]+")
