"""Vector expressions over ARRAY<FLOAT|DOUBLE> columns; arithmetic is always DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-12  # fixed value: smallest divisor used when normalising


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(vec), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 when either one is all zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0.0, F.lit(0.0)).otherwise(dot(a, b) / size)


def unit(vec: Column, floor: float = NORM_FLOOR) -> Column:
    """`vec / max(|vec|, floor)`; an all-zero vector stays all zero.

    The division sits in the finish step of the sum, so that the norm is computed once per
    vector and not once per element.
    """
    items = as_double(vec)
    return F.aggregate(
        items,
        F.lit(0.0),
        lambda acc, x: acc + x * x,
        lambda squares: F.transform(items, lambda x: x / F.greatest(F.sqrt(squares), F.lit(floor))),
    )
