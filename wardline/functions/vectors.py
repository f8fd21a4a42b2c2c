"""Column expressions over vectors (arrays of numbers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def l1_normalise(a: Column) -> Column:
    """Shares that sum to one; null unless the sum is positive."""
    return F.when(total(a) > 0, F.transform(a, lambda x: x / total(a)))


def histogram(raw: Column) -> Column:
    """Non-negative shares of any vector: absolute values, normalised."""
    return F.transform(raw, lambda x: F.abs(x.cast("double")))


def intersection(a: Column, b: Column) -> Column:
    """Sum of the smaller entries; 0 for null or unequal lengths."""
    return F.when(F.size(a) == F.size(b), total(F.zip_with(a, b, lambda x, y: F.least(x, y)))).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def blend(old: Column, new: Column, weight: float = 0.3) -> Column:
    """Old nudged towards new and normalised again; the one that is there if the other is null."""
    mixed = F.zip_with(old, new, lambda x, y: x * (1 - weight) + y * weight)
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(l1_normalise(mixed))
