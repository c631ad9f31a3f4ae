"""Point sets, grids and extents as DataFrames with metadata."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions import affine, projection


@dataclass(frozen=True)
class Extent:
    """An axis-aligned box."""

    low: tuple[float, ...]
    high: tuple[float, ...]

    @staticmethod
    def of(df: DataFrame, axes: Sequence[str]) -> Extent | None:
        """Box of all points in one aggregate; None if there are none."""
        row = df.agg(*(F.min(a).alias(f"l{i}") for i, a in enumerate(axes)), *(F.max(a).alias(f"h{i}") for i, a in enumerate(axes))).first()
        if row["l0"] is None:
            return None
        return Extent(tuple(row[f"l{i}"] for i in range(len(axes))), tuple(row[f"h{i}"] for i in range(len(axes))))

    @property
    def dim(self) -> int:
        return len(self.low)

    @property
    def ranges(self) -> tuple[float, ...]:
        return tuple(h - lo for lo, h in zip(self.low, self.high))

    @property
    def center(self) -> tuple[float, ...]:
        return tuple((h + lo) / 2 for lo, h in zip(self.low, self.high))

    @property
    def corners(self) -> np.ndarray:
        return affine.box_corners(self.low, self.high)

    def split(self) -> tuple[tuple[float, ...], tuple[float, ...]]:
        return self.low, self.high

    def contains(self, axes: Sequence[str]) -> Column:
        """Closed membership; narrower axes are tested first."""
        order = sorted(range(self.dim), key=lambda i: self.ranges[i])
        test = F.lit(True)
        for i in order:
            test = test & F.col(axes[i]).between(self.low[i], self.high[i])
        return test


@dataclass(frozen=True)
class PointFrame:
    """Rows with a stable id and one double column per axis, and what is known about them.

    Every operation returns a new frame; nothing is cached or changed in place.
    """

    df: DataFrame
    axes: tuple[str, ...] = ("x", "y", "z")
    id: str = "id"
    crs: str | None = None
    t: np.ndarray | None = field(default=None, compare=False)
    date: datetime | None = None

    def __post_init__(self) -> None:
        kinds = {f.name: f.dataType for f in self.df.schema.fields}
        missing = [c for c in (*self.axes, self.id) if c not in kinds]
        if missing:
            raise ValueError(f"no such columns: {missing}")
        for a in self.axes:
            if not isinstance(kinds[a], T.NumericType):
                raise TypeError(f"axis {a} is not numeric")
        if self.t is not None and affine.check(self.t).shape[0] != len(self.axes) + 1:
            raise ValueError("the matrix has another dimension than the points")
        if self.crs is None:
            object.__setattr__(self, "crs", "EPSG:4326")
            warnings.warn("no system given; EPSG:4326 is assumed", stacklevel=2)

    @property
    def dim(self) -> int:
        return len(self.axes)

    def count(self) -> int:
        return self.df.count()

    def extent(self, dim: int | None = None) -> Extent | None:
        return Extent.of(self.df, self.axes[:dim])

    def records(self) -> PointFrame:
        """The flat rows; frames always are."""
        return self

    def with_df(self, df: DataFrame) -> PointFrame:
        return replace(self, df=df)

    def select_ids(self, ids: DataFrame) -> PointFrame:
        """Rows by id; repeated ids give repeated rows."""
        return self.with_df(ids.select(self.id).join(self.df, self.id))

    def where(self, condition: Column | str) -> PointFrame:
        return self.with_df(self.df.where(condition))

    def transform(self, T: np.ndarray, invert: bool = False) -> PointFrame:
        moved = affine.transform(self.axes, T, invert)
        matrix = affine.inverse(T) if invert else affine.check(T)
        t = matrix @ (self.t if self.t is not None else np.eye(self.dim + 1))
        return replace(self, df=self.df.withColumns(dict(zip(self.axes, moved))), t=t)

    def project(self, crs: str) -> PointFrame:
        """x and y in another system (EPSG:25832, EPSG:4326 or EPSG:3857); other axes stay."""
        x, y = projection.reproject(F.col(self.axes[0]), F.col(self.axes[1]), self.crs, crs)
        return replace(self, df=self.df.withColumns({self.axes[0]: x, self.axes[1]: y}), crs=crs)

    def merge(self, other: PointFrame) -> PointFrame:
        from fieldloom.operators.records import merge  # noqa: PLC0415

        return self.with_df(merge(self.df, other.df))

    def add_fields(self, **columns: Column) -> PointFrame:
        from fieldloom.operators.records import add_fields  # noqa: PLC0415

        return self.with_df(add_fields(self.df, columns))
