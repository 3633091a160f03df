"""Boxes (x0, y0, x1, y1) on a page, in shares of its size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def normalized(box: Box) -> Column:
    """The box within the page, as an array; null where nothing is left of it."""
    x0, y0, x1, y1 = map(clamp, box)
    return F.when((x1 > x0) & (y1 > y0), F.array(x0, y0, x1, y1))


def area(box: Box) -> Column:
    return F.greatest(box[2] - box[0], F.lit(0.0)) * F.greatest(box[3] - box[1], F.lit(0.0))


def overlap_share(box: Box, other: Box) -> Column:
    """Share of the box's area that the other covers; null for a box without one."""
    both = area((F.greatest(box[0], other[0]), F.greatest(box[1], other[1]), F.least(box[2], other[2]), F.least(box[3], other[3])))
    return both / F.nullif(area(box), F.lit(0.0))
