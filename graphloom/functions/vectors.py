"""Vector arithmetic on arrays, in native expressions and doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is 0."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (n == 0), F.lit(0.0)).otherwise(dot(a, b) / n)


def nudge(a: Column, b: Column, rate: float, weight: Column) -> tuple[Column, Column]:
    """Both ends of an edge drawn towards each other by rate x weight x difference."""
    f = F.lit(rate) * weight
    return F.zip_with(a, b, lambda x, y: x + f * (y - x)), F.zip_with(a, b, lambda x, y: y - f * (y - x))
