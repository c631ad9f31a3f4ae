"""Transformation matrices on the driver, and their application as column expressions.

Matrices are homogeneous, (k + 1) x (k + 1), as numpy arrays. Applying one folds
its elements into literals, so a transformation costs k multiplications per axis
inside whole-stage code and no Python.
"""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.distance import Point, as_columns


def check(T: np.ndarray) -> np.ndarray:
    """A homogeneous matrix as floats. Raises ``ValueError`` unless it is square."""
    T = np.asarray(T, float)
    if T.ndim != 2 or T.shape[0] != T.shape[1] or T.shape[0] < 2:
        raise ValueError("a square matrix is needed")
    return T


def identity(dim: int) -> np.ndarray:
    return np.eye(dim + 1)


def translation(t: Sequence[float]) -> np.ndarray:
    T = np.eye(len(t) + 1)
    T[:-1, -1] = t
    return T


def scaling(s: Sequence[float]) -> np.ndarray:
    return np.diag([*map(float, s), 1.0])


def rotation(angles: float | Sequence[float], order: str = "xyz") -> np.ndarray:
    """Rotation by one angle in the plane, or by three about the axes; the first letter of ``order`` applies first."""
    a = np.atleast_1d(np.asarray(angles, float))
    if len(a) == 1:
        T = np.eye(3)
        T[:2, :2] = _turn(a[0])
        return T
    if len(a) != 3:
        raise ValueError("one angle in 2-D, three in 3-D")
    if sorted(order) != ["x", "y", "z"]:
        raise ValueError(f"order {order!r} unknown")
    T = np.eye(4)
    for axis in ("xyz".index(letter) for letter in order):
        step = np.eye(4)
        i, j = (axis + 1) % 3, (axis + 2) % 3
        step[np.ix_((i, j), (i, j))] = _turn(a[axis])
        T = step @ T
    return T


def _turn(angle: float) -> np.ndarray:
    c, s = np.cos(angle), np.sin(angle)
    return np.array([[c, -s], [s, c]])


def quaternion(q: Sequence[float]) -> np.ndarray:
    """Rotation matrix of a unit quaternion (w, x, y, z), norm within 0.1 percent of 1."""
    w, x, y, z = map(float, q)
    if abs(w * w + x * x + y * y + z * z - 1) > 0.001:
        raise ValueError("the quaternion is not of unit length")
    T = np.eye(4)
    T[:3, :3] = [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]
    return T


def compose(t: Sequence[float] | None = None, r: float | Sequence[float] | None = None, s: Sequence[float] | None = None, order: str = "srt") -> np.ndarray:
    """Matrix of scaling, rotation and translation, applied in the sequence of ``order``."""
    if sorted(order) != ["r", "s", "t"]:
        raise ValueError(f"order {order!r} unknown")
    parts = {key: f(v) for key, f, v in (("t", translation, t), ("r", rotation, r), ("s", scaling, s)) if v is not None}
    if not parts:
        raise ValueError("nothing to compose")
    if len({p.shape for p in parts.values()}) != 1:
        raise ValueError("dimensions differ")
    T = np.eye(next(iter(parts.values())).shape[0])
    for key in order:
        T = parts.get(key, np.eye(len(T))) @ T
    return T


def add_dim(T: np.ndarray) -> np.ndarray:
    """The matrix embedded in one more dimension, which it leaves as it is."""
    T = check(T)
    k = len(T) - 1
    out = np.eye(k + 2)
    out[:k, :k], out[:k, -1] = T[:k, :k], T[:k, -1]
    return out


def decomposition(T: np.ndarray) -> tuple[np.ndarray, np.ndarray | float, np.ndarray, float]:
    """Translation, rotation angles, scale (lengths of the columns, so never negative) and determinant."""
    T = check(T)
    k = len(T) - 1
    scale = np.linalg.norm(T[:, :k], axis=0)
    R = T[:k, :k] / scale
    if k == 2:
        one, two = np.arctan2(R[1, 0], R[1, 1]), np.arctan2(-R[0, 1], R[0, 0])
        if not np.isclose(one, two):
            warnings.warn("the axes are turned by different angles", stacklevel=2)
        angle: np.ndarray | float = float(one + two) / 2
    elif k == 3:
        flat = float(np.hypot(R[0, 0], R[1, 0]))
        y = np.arctan2(-R[2, 0], flat)
        angle = np.array([np.arctan2(R[2, 1], R[2, 2]), y, np.arctan2(R[1, 0], R[0, 0])] if flat >= 1e-6 else [np.arctan2(-R[1, 2], R[1, 1]), y, 0.0])
    else:
        raise ValueError("2 or 3 dimensions")
    return T[:k, -1].copy(), angle, scale, float(np.linalg.det(T))


def from_gdal(t: Sequence[float]) -> np.ndarray:
    """Matrix of the six numbers (x, dx_col, dx_row, y, dy_col, dy_row)."""
    x, a, b, y, c, d = map(float, t)
    return np.array([[a, b, x], [c, d, y], [0, 0, 1]])


def to_gdal(T: np.ndarray) -> tuple[float, ...]:
    """The six numbers of a 2-D matrix, in double precision."""
    T = check(T)
    return (T[0, 2], T[0, 0], T[0, 1], T[1, 2], T[1, 0], T[1, 1])


def reflection(T: np.ndarray, axis: int) -> np.ndarray:
    """The system with one of its axes reversed."""
    T = check(T)
    flip = np.eye(len(T))
    flip[axis, axis] = -1
    return inverse(inverse(T) @ flip)


def inverse(T: np.ndarray) -> np.ndarray:
    """Inverse matrix; of a singular one the pseudo-inverse, with a warning."""
    T = check(T)
    try:
        return np.linalg.inv(T)
    except np.linalg.LinAlgError:
        warnings.warn("the matrix is singular; its pseudo-inverse is used", stacklevel=2)
        return np.linalg.pinv(T)


def transform(point: Point, T: np.ndarray, invert: bool = False) -> list[Column]:
    """Transformed axes of a point, as expressions with literal coefficients."""
    T = inverse(T) if invert else check(T)
    axes = as_columns(point)
    if len(T) != len(axes) + 1:
        raise ValueError("dimensions differ")
    out = []
    for row in T[:-1]:
        total = F.lit(float(row[-1]))
        for value, c in zip(row[:-1], axes):
            if value:
                total = total + (c if value == 1 else F.lit(float(value)) * c)
        out.append(total)
    return out


def to_local(point: Point, T: np.ndarray) -> list[Column]:
    """T applied: as the matrix sees it, from its own axes to the outer ones."""
    return transform(point, T)


def to_global(point: Point, T: np.ndarray) -> list[Column]:
    """The inverse of ``to_local``."""
    return transform(point, T, invert=True)


def homogeneous(point: Point, value: float = 1.0) -> list[Column]:
    """The axes and one more of a constant value."""
    return [*as_columns(point), F.lit(float(value))]


def apply(T: np.ndarray, coords: np.ndarray) -> np.ndarray:
    """T applied to a small array of points on the driver."""
    coords = np.atleast_2d(np.asarray(coords, float))
    return coords @ check(T)[:-1, :-1].T + T[:-1, -1]


def box_corners(low: Sequence[float], high: Sequence[float]) -> np.ndarray:
    """Corners of a box in Gray-code order: neighbouring corners share an edge."""
    dim = len(low)
    bits = [[(i ^ (i >> 1)) >> axis & 1 for axis in range(dim)] for i in range(2**dim)]
    return np.where(np.array(bits), np.asarray(high, float), np.asarray(low, float))


def fit_affine(A: np.ndarray, B: np.ndarray) -> np.ndarray:
    """Least-squares affine matrix that maps the points B to A."""
    A, B = np.atleast_2d(A).astype(float), np.atleast_2d(B).astype(float)
    solved = np.linalg.lstsq(np.column_stack([B, np.ones(len(B))]), np.column_stack([A, np.ones(len(A))]), rcond=None)[0].T
    return solved


def corners_to_transform(corners: np.ndarray, scale: Sequence[float] | None = None) -> tuple[np.ndarray, tuple[int, ...]]:
    """Matrix of a grid with the given corners and cell sizes, and its shape (rows first)."""
    corners = np.asarray(corners, float)
    dim = corners.shape[1]
    scale = np.ones(dim) if scale is None else np.asarray(scale, float)
    unit = box_corners(np.zeros(dim), np.sign(scale))
    t, r, _, _ = decomposition(fit_affine(corners, unit))
    T = compose(t=t, r=r, s=scale)
    cells = apply(inverse(T), corners) + 0.5
    return T, tuple(int(v) for v in cells.max(axis=0)[::-1])


def transform_to_corners(T: np.ndarray, shape: Sequence[int]) -> np.ndarray:
    """Corners of a grid of the given shape."""
    return apply(T, box_corners(np.zeros(len(shape)), np.asarray(shape, float)[::-1]))


def grid_keys(T: np.ndarray, coords: np.ndarray) -> np.ndarray:
    """Cell keys of a few points on the driver, axes reversed, truncated toward zero."""
    return np.trunc(np.round(apply(inverse(T), coords), 9)).astype(int)[:, ::-1]


def extent_window(T: np.ndarray, low: Sequence[float], high: Sequence[float]) -> tuple[np.ndarray, tuple[int, ...], tuple[int, ...]]:
    """Matrix, origin key and inclusive shape of the part of a grid that a box covers."""
    keys = grid_keys(T, box_corners(low, high))
    origin = keys.min(axis=0)
    out = check(T).copy()
    out[:-1, -1] = apply(T, origin[::-1][None, :].astype(float))[0]
    return out, tuple(int(v) for v in origin), tuple(int(v) for v in keys.max(axis=0) - origin + 1)


def eigen_of(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors (columns) and values of a symmetric matrix, descending; the largest component of each is positive."""
    values, vectors = np.linalg.eigh(scatter)
    values, vectors = values[::-1], vectors[:, ::-1]
    lead = np.argmax(np.abs(vectors), axis=0)
    return vectors * np.where(vectors[lead, np.arange(vectors.shape[1])] < 0, -1.0, 1.0), values


def orders() -> list[str]:
    """The sequences in which scaling, rotation and translation may be composed."""
    return ["".join(p) for p in itertools.permutations("srt")]
