"""Column functions over arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, least: float = 0.0) -> Column:
    """0 if a norm is ``least`` or less."""
    x, y = norm(a), norm(b)
    return F.when((x <= least) | (y <= least), F.lit(0.0)).otherwise(dot(a, b) / (x * y))


def scaled(v: Column, by: Column) -> Column:
    # worked out once, and not at every number
    return F.get(F.transform(F.array(by), lambda n: F.transform(doubles(v), lambda x: x / n)), F.lit(0))


def l2_normalise(v: Column, least: float = 1e-10) -> Column:
    """Divided by the norm, which counts as ``least`` at least."""
    return scaled(v, F.greatest(norm(v), F.lit(least)))


def add(a: Column, b: Column, weight: float = 1.0) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + weight * y)


def triangular_weights(n: Column) -> Column:
    """1 - |i - n/2 + 0.5| / (n/2) for i below n; a single 1 for n of 1."""
    half = n / 2.0
    rising = F.transform(F.sequence(F.lit(0), n - 1), lambda i: 1 - F.abs(i - half + 0.5) / half)
    return F.when(n <= 1, F.array_repeat(F.lit(1.0), n)).otherwise(rising)
