"""Vector geometry: angles, directions and polar coordinates as column expressions; lines and planes."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import affine
from fieldloom.functions.distance import Point, as_columns, norm, snorm
from fieldloom.session import checkpoint


def rad_to_deg(angle: Column) -> Column:
    return F.degrees(angle)


def deg_to_rad(angle: Column) -> Column:
    return F.radians(angle)


def scalarproduct(v: Point, w: Point) -> Column:
    """Sum of the products by axis."""
    return reduce(add, [a * b for a, b in zip(as_columns(v), as_columns(w), strict=True)])


def orthogonal(v: Point, w: Point) -> Column:
    """Whether the scalar product is exactly 0."""
    return scalarproduct(v, w) == 0


def _unit(value: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))


def angle(v: Point, w: Point, deg: bool = False) -> Column:
    """Angle between two vectors; infinite if one of them has no length."""
    length = F.sqrt(snorm(v) * snorm(w))
    value = F.acos(_unit(scalarproduct(v, w) / F.nullif(length, F.lit(0.0))))
    value = F.degrees(value) if deg else value
    return F.when(length == 0, F.lit(math.inf)).otherwise(value)


def axes_angles(v: Point, deg: bool = False) -> list[Column]:
    """Angles to each of the axes."""
    axes = as_columns(v)
    return [angle(axes, [float(i == j) for j in range(len(axes))], deg) for i in range(len(axes))]


def direction(v: Point, deg: bool = False) -> list[Column]:
    """Direction angles: one in 2-D (arc sine of y over the length), azimuth and inclination in 3-D. No length gives null."""
    axes = as_columns(v)
    length = F.nullif(norm(axes), F.lit(0.0))
    if len(axes) == 2:
        out = [F.asin(_unit(axes[1] / length))]
    elif len(axes) == 3:
        out = [F.when(length.isNotNull(), F.atan2(axes[1], axes[0])), F.acos(_unit(axes[2] / length))]
    else:
        raise ValueError("2 or 3 dimensions")
    return [F.degrees(a) for a in out] if deg else out


def zenith(v: Point, axis: int = -1, deg: bool = False) -> Column:
    """Angle to an axis, the last by default; null for a vector of no length."""
    axes = as_columns(v)
    value = F.acos(_unit(axes[axis] / F.nullif(norm(axes), F.lit(0.0))))
    return F.degrees(value) if deg else value


def azimuth(v: Point, deg: bool = False) -> Column:
    """Angle clockwise from the second axis, from 0 up to a full turn; null for (0, 0)."""
    x, y = as_columns(v)[:2]
    value = F.when(~((x == 0) & (y == 0)), math.pi - F.atan2(x, -y))
    return F.degrees(value) if deg else value


def to_polar(v: Point) -> list[Column]:
    """(distance, angle) in 2-D; (distance, azimuth, inclination) in 3-D, 0 at the origin."""
    axes = as_columns(v)
    d = norm(axes)
    if len(axes) == 2:
        return [d, F.atan2(axes[1], axes[0])]
    if len(axes) == 3:
        return [d, F.atan2(axes[1], axes[0]), F.when(d == 0, F.lit(0.0)).otherwise(F.acos(_unit(axes[2] / F.nullif(d, F.lit(0.0)))))]
    raise ValueError("2 or 3 dimensions")


def from_polar(p: Point) -> list[Column]:
    """The inverse of ``to_polar``."""
    a = as_columns(p)
    if len(a) == 2:
        return [a[0] * F.cos(a[1]), a[0] * F.sin(a[1])]
    if len(a) == 3:
        flat = a[0] * F.sin(a[2])
        return [flat * F.cos(a[1]), flat * F.sin(a[1]), a[0] * F.cos(a[2])]
    raise ValueError("2 or 3 dimensions")


def basis(vec: Sequence[float], origin: Sequence[float] | None = None) -> np.ndarray:
    """Local system whose first axis is the direction of ``vec``: maps outer to local coordinates."""
    v = np.asarray(vec, float)
    if not np.linalg.norm(v):
        raise ValueError("a vector of no length has no direction")
    full, _ = np.linalg.qr(np.column_stack([v, np.eye(len(v))]))
    rows = full[:, : len(v)].T
    rows[0] *= np.sign(rows[0] @ v)
    T = np.eye(len(v) + 1)
    T[:-1, :-1] = rows
    T[:-1, -1] = -rows @ np.asarray(np.zeros(len(v)) if origin is None else origin, float)
    return T


@dataclass(frozen=True)
class Line:
    """A line from ``origin`` along ``vec``; parameter 0 is the origin, 1 its target."""

    origin: tuple[float, ...]
    vec: tuple[float, ...]

    @staticmethod
    def from_angles(origin: Sequence[float], angles: Sequence[float]) -> Line:
        """A unit vector from one angle in 2-D, or azimuth and inclination in 3-D."""
        if len(origin) == 2:
            return Line(tuple(origin), (math.cos(angles[0]), math.sin(angles[0])))
        a, i = angles[:2]
        return Line(tuple(origin), (math.sin(i) * math.cos(a), math.sin(i) * math.sin(a), math.cos(i)))

    @property
    def dim(self) -> int:
        return len(self.vec)

    @property
    def length(self) -> float:
        return float(np.linalg.norm(self.vec))

    @property
    def target(self) -> tuple[float, ...]:
        return tuple(a + b for a, b in zip(self.origin, self.vec))

    @property
    def t(self) -> np.ndarray:
        return basis(self.vec, self.origin)

    def transform(self, T: np.ndarray) -> Line:
        a, b = affine.apply(T, np.array([self.origin, self.target]))
        return Line(tuple(map(float, a)), tuple(map(float, b - a)))

    def __mul__(self, s: float) -> Line:
        return Line(self.origin, tuple(float(v * s) for v in self.vec))

    def __truediv__(self, s: float) -> Line:
        return self * (1 / s)

    def k(self, point: Point) -> Column:
        """Parameter of the nearest point on the line."""
        return scalarproduct([c - o for c, o in zip(as_columns(point), self.origin)], self.vec) / self.length**2

    def at(self, k: Column) -> list[Column]:
        """Point at a parameter."""
        return [F.lit(float(o)) + float(v) * k for o, v in zip(self.origin, self.vec)]

    def angles(self, deg: bool = False) -> list[float]:
        out = [math.acos(max(-1.0, min(1.0, v / self.length))) for v in self.vec]
        return [math.degrees(a) for a in out] if deg else out

    def distance(self, point: Point) -> Column:
        """Perpendicular distance of a point."""
        axes = as_columns(point)
        return norm([c - a for c, a in zip(axes, self.at(self.k(axes)))])


@dataclass(frozen=True)
class Plane:
    """A hyperplane through ``origin`` along k - 1 vectors."""

    origin: tuple[float, ...]
    vectors: tuple[tuple[float, ...], ...]

    @property
    def dim(self) -> int:
        return len(self.origin)

    @property
    def normal(self) -> np.ndarray:
        """Unit normal; its largest component is positive."""
        _, _, vt = np.linalg.svd(np.array(self.vectors, float))
        n = vt[-1]
        return n * np.sign(n[np.argmax(np.abs(n))])

    @property
    def target(self) -> tuple[float, ...]:
        return tuple(float(v) for v in np.asarray(self.origin) + np.sum(self.vectors, axis=0))

    @property
    def t(self) -> np.ndarray:
        rows = np.vstack([np.linalg.qr(np.array(self.vectors, float).T)[0].T, self.normal])
        T = np.eye(self.dim + 1)
        T[:-1, :-1], T[:-1, -1] = rows, -rows @ np.asarray(self.origin, float)
        return T

    def transform(self, T: np.ndarray) -> Plane:
        points = affine.apply(T, np.vstack([self.origin, np.asarray(self.origin) + np.array(self.vectors)]))
        return Plane(tuple(map(float, points[0])), tuple(tuple(map(float, p - points[0])) for p in points[1:]))

    def __mul__(self, s: float) -> Plane:
        return Plane(self.origin, tuple(tuple(float(v * s) for v in vec) for vec in self.vectors))

    def __truediv__(self, s: float) -> Plane:
        return self * (1 / s)

    def at(self, *k: Column) -> list[Column]:
        """Point at parameters along the vectors."""
        return [F.lit(float(o)) + reduce(add, [float(v[i]) * kk for v, kk in zip(self.vectors, k, strict=True)]) for i, o in enumerate(self.origin)]

    def distance(self, point: Point) -> Column:
        """Distance of a point, never negative."""
        return F.abs(scalarproduct([c - o for c, o in zip(as_columns(point), self.origin)], [float(v) for v in self.normal]))


def plane_intersection(origin: Point, vec: Point, plane: Plane) -> list[Column]:
    """Where lines of a table meet a plane; null where a line is parallel to it."""
    n = [float(v) for v in plane.normal]
    o, v = as_columns(origin), as_columns(vec)
    down = scalarproduct(v, n)
    k = scalarproduct([F.lit(float(p)) - c for p, c in zip(plane.origin, o)], n) / F.when(F.abs(down) > 1e-12, down)
    return [a + k * b for a, b in zip(o, v)]


def surface_intersection(lines: DataFrame, height: Callable[[DataFrame, str, str, str], DataFrame], eps: float = 0.001, max_iter: int = 20) -> DataFrame:
    """Where lines (id, ox, oy, oz, vx, vy, vz) meet a surface, by fixed-point iteration of all at once.

    ``height(df, x, y, out)`` adds the surface's height at two columns. Returns
    id, x, y, z; a line that has not come within ``eps`` after ``max_iter``
    rounds, or that has no vertical part, gives nulls. One round is one pass of
    ``height``; every second one is written to a table.
    """
    rows = lines.withColumns({"_x": F.col("ox"), "_y": F.col("oy"), "_z": F.col("oz"), "_done": F.lit(False)})
    steep = F.when(F.abs("vz") > 1e-12, F.col("vz"))
    for i in range(max_iter):
        if i % 2:  # a long chain of expressions would not be compiled
            rows = checkpoint(rows)
        rows = height(rows, "_x", "_y", "_h")
        k = (F.col("_h") - F.col("oz")) / steep
        rows = rows.withColumn("_done", F.coalesce(F.abs(F.col("_z") - F.col("_h")) < eps, F.lit(False)))
        rows = rows.withColumns({"_x": F.col("ox") + k * F.col("vx"), "_y": F.col("oy") + k * F.col("vy"), "_z": F.col("_h")}).drop("_h")
        if not rows.where("not _done").take(1):
            break
    value = lambda c: F.when(F.col("_done"), F.col(c))
    return rows.select("id", value("_x").alias("x"), value("_y").alias("y"), value("_z").alias("z"))
