"""Vector functions as column expressions over array<double>, left folds as in a plain loop."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """0 where a norm is 0."""
    return F.when(norm_a * norm_b == 0, F.lit(0.0)).otherwise(dot(a, b) / (norm_a * norm_b))


def round_half_up(x: Column, places: int = 3) -> Column:
    """Halves toward plus infinity."""
    return F.floor(x * 10**places + 0.5) / 10**places


def round_half_even(x: Column, places: int = 3) -> Column:
    return F.bround(x, places)


def normalise(v: Column, eps: float | None = None) -> Column:
    """Unit length; a zero vector stays as it is. With eps, v / (|v| + eps)."""
    n = norm(v)
    if eps is not None:
        return F.transform(v, lambda x: x / (n + eps))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def matrix_product(rows: Column, v: Column) -> Column:
    """rows: array of arrays; the product of that matrix and v."""
    return F.transform(rows, lambda r: dot(r, v))


def axis_slice(v: Column, axis: int, width: int) -> Column:
    return F.slice(v, axis * width + 1, width)


def ramp(i: Column, start: float = 1.0, step: float = 0.06) -> Column:
    """Scores of fallback results by position."""
    return round_half_up(F.lit(start) - F.lit(step) * i, 3)
