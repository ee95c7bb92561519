"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MS_PER_DAY = 86_400_000


def finite(c: Column) -> Column:
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def clamp(c: Column, low: float, high: float, fallback: float) -> Column:
    """Between low and high; the fallback where there is no finite number."""
    # greatest and least pass nulls over, so they are asked for first
    return F.when(finite(c).isNull(), F.lit(fallback)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), finite(c))))


def clamp01(c: Column, fallback: float = 0.0) -> Column:
    return clamp(c, 0.0, 1.0, fallback)


def count_of(c: Column, fallback: Column | int = 0) -> Column:
    """Whole count of a number that is not negative."""
    c = finite(c)
    return F.when(c >= 0, F.floor(c)).otherwise(fallback if isinstance(fallback, Column) else F.lit(fallback)).cast("bigint")


def round_half_up(c: Column) -> Column:
    """The next whole number, halves upwards also below zero."""
    return F.floor(c + 0.5).cast("bigint")


def min_max(c: Column, window) -> Column:
    """To 0..1 over a window; 0.5 where all are equal."""
    low, high = F.min(c).over(window), F.max(c).over(window)
    return F.when(high == low, 0.5).otherwise((c - low) / (high - low))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different or no length and for zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def weighted_mean_vector(vectors: Column) -> Column:
    """Mean of chunk vectors, the first with weight 1.2, the last 1.1, others 1."""
    n = F.size(vectors)
    weight = lambda i: F.when(i == 0, 1.2).when(i == n - 1, 1.1).otherwise(1.0)
    weighted = F.transform(vectors, lambda v, i: F.transform(v, lambda x: x.cast("double") * weight(i)))
    total = F.aggregate(F.transform(vectors, lambda v, i: weight(i)), F.lit(0.0), lambda s, w: s + w)
    zero = F.transform(vectors[0], lambda x: F.lit(0.0))
    return F.aggregate(weighted, zero, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y), lambda acc: F.transform(acc, lambda x: x / total))
