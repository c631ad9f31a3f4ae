"""Grids and voxel spaces: keys, windows, and aggregation by cell.

A grid is sparse: one row per occupied cell with its keys ``key_0`` (the last
axis), ..., and attributes. Keys run in the reverse order of the axes, and a
cell's position is its centre. Dense grids join the sparse one to all keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import affine
from fieldloom.operators.frame import Extent
from fieldloom.operators.records import keys_of


def coords_to_keys(T: np.ndarray, axes: Sequence[str], rounding: str = "trunc") -> list[Column]:
    """Keys of a position: its local coordinates, cut toward zero (or down, for ``floor``), axes reversed."""
    local = affine.transform(axes, T, invert=True)
    cut = (lambda c: F.floor(c).cast("int")) if rounding == "floor" else (lambda c: c.cast("int"))
    return [cut(c).alias(f"key_{i}") for i, c in enumerate(reversed(local))]


def keys_to_coords(T: np.ndarray, dim: int) -> list[Column]:
    """Centre of the cell of ``key_0``..., one column per axis."""
    centre = [F.col(f"key_{i}") + 0.5 for i in reversed(range(dim))]
    return affine.transform(centre, T)


def coords_to_coords(T: np.ndarray, axes: Sequence[str]) -> list[Column]:
    """Centre of the cell of a position."""
    keys = coords_to_keys(T, axes)
    return affine.transform([k + 0.5 for k in reversed(keys)], T)


def keys_to_index(shape: Sequence[int]) -> Column:
    """Row-major number of the key."""
    total = F.lit(0).cast("bigint")
    for i, n in enumerate(shape):
        total = total * F.lit(n) + F.col(f"key_{i}")
    return total


def index_to_keys(index: Column, shape: Sequence[int]) -> list[Column]:
    """Key of a row-major number."""
    out, rest = [], index
    for i in reversed(range(len(shape))):
        out.append(F.pmod(rest, F.lit(shape[i])).cast("int").alias(f"key_{i}"))
        rest = F.floor(rest / shape[i])
    return list(reversed(out))


def inside(shape: Sequence[int]) -> Column:
    """Whether the key lies in the shape."""
    test = F.lit(True)
    for i, n in enumerate(shape):
        test = test & (F.col(f"key_{i}") >= 0) & (F.col(f"key_{i}") < n)
    return test


def voxelize(df: DataFrame, axes: Sequence[str], T: np.ndarray, aggregates: Sequence[Column], shape: Sequence[int] | None = None, fill: dict | None = None, rounding: str = "trunc") -> DataFrame:
    """Aggregates by cell: keys and the aggregates.

    Aggregation is partial before the shuffle. With a ``shape``, rows outside it
    are dropped before keys are numbered, and every cell of the shape comes out;
    empty ones have nulls, or the values of ``fill`` by column. Axes may be fewer
    than the table has. Rows of null coordinates belong to no cell.
    """
    keys = coords_to_keys(T, axes, rounding)
    names = [f"key_{i}" for i in range(len(axes))]
    keyed = df.withColumns(dict(zip(names, keys)))
    for n in names:
        keyed = keyed.where(F.col(n).isNotNull())
    if shape is not None:
        keyed = keyed.where(inside(shape))
    sparse = keyed.groupBy(*names).agg(*aggregates)
    if shape is None:
        return sparse
    dense = keys_of(df.sparkSession, shape).join(sparse, names, "left")
    for column, value in (fill or {}).items():
        dense = dense.withColumn(column, F.coalesce(column, F.lit(value)))
    return dense


def collect_cells(df: DataFrame, axes: Sequence[str], T: np.ndarray, fields: Sequence[str]) -> DataFrame:
    """Keys with the list of the rows of each cell as structs; meant for cells of bounded content."""
    return voxelize(df, axes, T, [F.collect_list(F.struct(*fields)).alias("rows")])


def voxelize_with(df: DataFrame, axes: Sequence[str], T: np.ndarray, function: Callable[[pd.DataFrame], dict], schema: str) -> DataFrame:
    """Any Python aggregate of the rows of a cell, vectorised by cell; built-in aggregates are far faster."""
    names = [f"key_{i}" for i in range(len(axes))]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{n: group[n].iloc[0] for n in names} | function(group)])

    keyed = df.withColumns(dict(zip(names, coords_to_keys(T, axes))))
    return keyed.groupBy(*names).applyInPandas(run, ", ".join(f"{n} int" for n in names) + ", " + schema)


@dataclass(frozen=True)
class Grid:
    """Sparse cells with a matrix and a shape."""

    df: DataFrame
    t: np.ndarray
    shape: tuple[int, ...]
    crs: str | None = None

    @staticmethod
    def empty(spark: SparkSession, t: np.ndarray, shape: Sequence[int], crs: str | None = None) -> Grid:
        """All cells of a shape, without attributes."""
        return Grid(keys_of(spark, shape), affine.check(t), tuple(shape), crs)

    @staticmethod
    def from_corners(spark: SparkSession, corners: np.ndarray, scale: Sequence[float], crs: str | None = None) -> Grid:
        t, shape = affine.corners_to_transform(corners, scale)
        return Grid.empty(spark, t, shape, crs)

    @staticmethod
    def from_extent(spark: SparkSession, extent: Extent, scale: Sequence[float], crs: str | None = None) -> Grid:
        return Grid.from_corners(spark, extent.corners, scale, crs)

    @property
    def dim(self) -> int:
        return len(self.shape)

    @property
    def corners(self) -> np.ndarray:
        return affine.transform_to_corners(self.t, self.shape)

    @property
    def extent(self) -> Extent:
        c = self.corners
        return Extent(tuple(c.min(axis=0)), tuple(c.max(axis=0)))

    def with_coords(self, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
        """Cells with their centres."""
        return self.df.withColumns(dict(zip(axes, keys_to_coords(self.t, self.dim))))

    def transform(self, T: np.ndarray) -> Grid:
        return Grid(self.df, affine.check(T) @ self.t, self.shape, self.crs)

    def window(self, extent: Extent) -> Grid:
        """Cells whose keys lie from the lowest to below the highest key of the extent's corners."""
        keys = affine.grid_keys(self.t, extent.corners)
        low, high = keys.min(axis=0), keys.max(axis=0)
        test = F.lit(True)
        for i in range(self.dim):
            test = test & (F.col(f"key_{i}") >= int(low[i])) & (F.col(f"key_{i}") < int(high[i]))
        moved = self.df.where(test).withColumns({f"key_{i}": (F.col(f"key_{i}") - int(low[i])).cast("int") for i in range(self.dim)})
        t = self.t.copy()
        t[:-1, -1] = affine.apply(self.t, low[::-1][None, :].astype(float))[0]
        return Grid(moved, t, tuple(int(v) for v in high - low), self.crs)

    def voxelize(self, df: DataFrame, axes: Sequence[str], aggregates: Sequence[Column], fill: dict | None = None) -> Grid:
        return Grid(voxelize(df, axes, self.t, aggregates, self.shape, fill), self.t, self.shape, self.crs)
