"""Distances and weights as column expressions over axis columns or arrays.

Points are given as sequences of columns, one per axis, or as one array column
whose length is not fixed. A null coordinate makes the result null.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Point = Sequence["Column | str | float"]


def as_columns(point: Point) -> list[Column]:
    """Axis columns of a point given by names, columns or numbers."""
    return [p if isinstance(p, Column) else F.col(p) if isinstance(p, str) else F.lit(float(p)) for p in point]


def snorm(point: Point) -> Column:
    """Squared length."""
    return reduce(add, [c * c for c in as_columns(point)])


def norm(point: Point) -> Column:
    """Length."""
    return F.sqrt(snorm(point))


def sdist(p: Point, q: Point) -> Column:
    """Squared distance. Raises ``ValueError`` if the dimensions differ."""
    a, b = as_columns(p), as_columns(q)
    if len(a) != len(b):
        raise ValueError("points of different dimension")
    return reduce(add, [(x - y) * (x - y) for x, y in zip(a, b)])


def dist(p: Point, q: Point) -> Column:
    """Distance."""
    return F.sqrt(sdist(p, q))


def idw(distance: Column, p: float = 2) -> Column:
    """Inverse distance weight 1 / (1 + d)**p."""
    return 1 / F.pow(1 + distance, F.lit(float(p)))


def rmse(df: DataFrame, a: Point, b: Point | None = None) -> DataFrame:
    """Root of the mean squared distance of two points per row, or of the lengths of one: one row, column ``rmse``."""
    square = snorm(a) if b is None else sdist(a, b)
    return df.agg(F.sqrt(F.avg(square)).alias("rmse"))


def array_sdist(a: Column, b: Column) -> Column:
    """Squared distance of two array columns of equal length (null if the lengths differ)."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
