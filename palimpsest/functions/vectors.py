"""Vector functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a norm is 0."""
    return F.lit(1.0) - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    """Scaled to length 1; null for a zero vector, which has no direction."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def truncate(a: Column, size: int) -> Column:
    """The first `size` numbers, scaled to length 1."""
    return l2_normalize(F.slice(a, 1, size))
