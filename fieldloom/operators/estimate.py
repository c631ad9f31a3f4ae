"""Estimators from moments: eigenvectors, normals, smoothing, spheres and cylinders.

Scatter matrices and normal equations are sums, so they are aggregated by Spark
with partial aggregation; only their small results are solved, on the driver for
one set and in vectorised Arrow calls for many. Coordinates are centred first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions import affine
from fieldloom.functions.distance import as_columns
from fieldloom.functions.vector import Line, scalarproduct
from fieldloom.operators import joins
from fieldloom.operators.filters import _greedy
from fieldloom.session import checkpoint, drop_checkpoint


def centre_of(df: DataFrame, axes: Sequence[str]) -> list[float] | None:
    """Mean position in one aggregate; None if there are no rows."""
    row = df.agg(*(F.avg(a).alias(f"m{i}") for i, a in enumerate(axes))).first()
    return None if row["m0"] is None else [row[f"m{i}"] for i in range(len(axes))]


def scatter_columns(axes: Sequence[Column]) -> list[Column]:
    """Sums of products of all pairs of axes (upper triangle, by rows)."""
    return [F.sum(axes[i] * axes[j]).alias(f"s{i}{j}") for i in range(len(axes)) for j in range(i, len(axes))]


def _matrix(values: Sequence[float], dim: int) -> np.ndarray:
    out = np.zeros((dim, dim))
    out[np.triu_indices(dim)] = values
    return out + np.triu(out, 1).T


def scatter(df: DataFrame, axes: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Centre, scatter matrix (not divided by the count) and count of all rows, in two passes."""
    centre = centre_of(df, axes)
    dim = len(axes)
    if centre is None:
        return np.zeros(dim), np.zeros((dim, dim)), 0
    moved = [F.col(a) - c for a, c in zip(axes, centre)]
    row = df.agg(F.count(axes[0]).alias("n"), *scatter_columns(moved)).first()
    return np.array(centre), _matrix([row[f"s{i}{j}"] for i in range(dim) for j in range(i, dim)], dim), row["n"]


def eigen(df: DataFrame, axes: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors (columns) and eigenvalues of the scatter matrix, descending."""
    return affine.eigen_of(scatter(df, axes)[1])


def pca(df: DataFrame, axes: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Local system whose axes are the eigenvectors and whose origin is the centre, and the eigenvalues."""
    centre, matrix, _ = scatter(df, axes)
    vectors, values = affine.eigen_of(matrix)
    out = np.eye(len(axes) + 1)
    out[:-1, :-1] = vectors.T
    out[:-1, -1] = -vectors.T @ centre
    return out, values


def components_of(system: np.ndarray, k: int) -> np.ndarray:
    """The k-th principal axis, from 1, of the local system that ``pca`` gives."""
    dim = len(system) - 1
    if not 1 <= k <= dim:
        raise ValueError(f"components are numbered from 1 to {dim}")
    return np.asarray(system)[k - 1, :dim]


def explained_variance(df: DataFrame, axes: Sequence[str], system: np.ndarray) -> DataFrame:
    """Population variance along each local axis, and its share: one row, var_i and ratio_i."""
    local = affine.to_local(axes, system)
    var = df.agg(*(F.var_pop(c).alias(f"var_{i}") for i, c in enumerate(local)))
    total = sum((F.col(f"var_{i}") for i in range(1, len(axes))), F.col("var_0"))
    return var.withColumns({f"ratio_{i}": F.try_divide(F.col(f"var_{i}"), total) for i in range(len(axes))})


def _eigh(dim: int, column: int) -> object:
    """Arrow function: (count, sums of axes, sums of products) to one eigenvector per row."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for n, *sums in batches:
            count = n.to_numpy(float)
            first = np.column_stack([s.to_numpy(float) for s in sums[:dim]])
            second = np.zeros((len(count), dim, dim))
            pairs = [(i, j) for i in range(dim) for j in range(i, dim)]
            for (i, j), s in zip(pairs, sums[dim:]):
                second[:, i, j] = second[:, j, i] = s.to_numpy(float)
            with np.errstate(invalid="ignore", divide="ignore"):
                second -= first[:, :, None] * first[:, None, :] / count[:, None, None]
            good = np.isfinite(second).all(axis=(1, 2)) & (count >= dim)
            out = np.zeros((len(count), dim))
            if good.any():
                vectors = np.linalg.eigh(second[good])[1][:, :, column]
                lead = np.abs(vectors).argmax(axis=1)
                out[good] = vectors * np.where(vectors[np.arange(len(vectors)), lead] < 0, -1.0, 1.0)[:, None]
            yield pd.Series(list(out + 0.0))

    return run


def group_vectors(df: DataFrame, group: Sequence[str], axes: Sequence[Column], column: int) -> DataFrame:
    """One eigenvector per group (0: least variance, -1: most), from moments about the group's first row's frame."""
    sums = [F.sum(a).alias(f"m{i}") for i, a in enumerate(axes)]
    moments = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *sums, *scatter_columns(axes))
    names = [c for c in moments.columns if c not in group]
    return moments.select(*group, "n", _eigh(len(axes), column)(*(F.col(c) for c in names)).alias("vector"))


def _neighbourhoods(df: DataFrame, axes: Sequence[str], r: float, k: int | None, id: str) -> DataFrame:
    """Pairs with the neighbour's position relative to the row's own (which keeps the moments small)."""
    if k is None:
        near = joins.ball(df, df, axes, r, id, carry=axes)
        return near.select("q_id", "r_id", *((F.col(f"r_{a}") - F.col(f"q_{a}")).alias(f"d{i}") for i, a in enumerate(axes)))
    pairs = joins.knn(df, df, axes, k, id, within=r if np.isfinite(r) else None)
    own = df.select(F.col(id).alias("q_id"), *(F.col(a).alias(f"_a{i}") for i, a in enumerate(axes)))
    other = df.select(F.col(id).alias("r_id"), *(F.col(a).alias(f"_b{i}") for i, a in enumerate(axes)))
    met = pairs.select("q_id", "r_id").join(own, "q_id").join(other, "r_id")
    return met.select("q_id", "r_id", *((F.col(f"_b{i}") - F.col(f"_a{i}")).alias(f"d{i}") for i in range(len(axes))))


def fit_normals(df: DataFrame, axes: Sequence[str], r: float = float("inf"), k: int | None = None, id: str = "id", preferred: Sequence[float] | None = None, compat: bool = False) -> DataFrame:
    """Normal of every row from its neighbours within r, or its k nearest strictly within r: id, normal.

    The normal is the direction of least scatter; with fewer neighbours than
    dimensions it is zero. Without ``preferred`` its largest component is
    positive; with it, normals are turned to its side.
    """
    dim = len(axes)
    if k is not None and k < dim:
        raise ValueError(f"k must be at least {dim}")
    near = _neighbourhoods(df, axes, r, k, id)
    found = group_vectors(near, ["q_id"], [F.col(f"d{i}") for i in range(dim)], 0).select(F.col("q_id").alias(id), F.col("vector").alias("normal"))
    if preferred is not None:
        found = found.withColumn("normal", F.array(*prefer_orientation([F.col("normal")[i] for i in range(dim)], preferred, compat)))
    return found


def normalize(vector: Sequence[Column | str]) -> list[Column]:
    """Vector of unit length; zero stays zero."""
    axes = as_columns(vector)
    length = F.sqrt(scalarproduct(axes, axes))
    return [F.when(length > 0, a / length).otherwise(F.lit(0.0)) for a in axes]


def prefer_orientation(normal: Sequence[Column | str], preferred: Sequence[float], compat: bool = False) -> list[Column]:
    """Zero becomes the preferred direction; normals on the other side are reversed.

    The other side begins at 90 degrees; with ``compat`` where the squared
    distance exceeds the number of dimensions (120 degrees in 3-D).
    """
    axes = as_columns(normal)
    unit = np.asarray(preferred, float) / np.linalg.norm(preferred)
    zero = scalarproduct(axes, axes) == 0
    if compat:
        away = sum(((a - float(u)) * (a - float(u)) for a, u in zip(axes[1:], unit[1:])), (axes[0] - float(unit[0])) ** 2) > len(axes)
    else:
        away = scalarproduct(axes, [float(u) for u in unit]) < 0
    return [F.when(zero, F.lit(float(u))).when(away, -a).otherwise(a) for a, u in zip(axes, unit)]


def approximate_normals(df: DataFrame, axes: Sequence[str], r: float, id: str = "id", preferred: Sequence[float] | None = None, k: int | None = None) -> DataFrame:
    """Normals fitted at few rows and given to all rows within r of them: id, normal.

    With ``k`` they are fitted to the k nearest rows within r.

    Rows are visited by id unless a visited row with enough neighbours is within
    r; of several normals a row is given, the one of the last visited row holds.
    """
    dim = len(axes)
    pairs = checkpoint(joins.ball(df, df, axes, r, id).select("q_id", "r_id"))
    full = checkpoint(pairs.groupBy("q_id").count().where(F.col("count") >= dim).select(F.col("q_id").alias("id")))
    edges = pairs.where("q_id < r_id").select(F.col("q_id").alias("src"), F.col("r_id").alias("dst"))
    edges = edges.join(full.withColumnRenamed("id", "src"), "src", "left_semi").join(full.withColumnRenamed("id", "dst"), "dst", "left_semi")
    visited = _greedy(edges, full)
    near = _neighbourhoods(df, axes, r, k, id).join(visited.withColumnRenamed("id", "q_id"), "q_id", "left_semi")
    normals = group_vectors(near, ["q_id"], [F.col(f"d{i}") for i in range(dim)], 0).select("q_id", "vector")
    given = pairs.join(normals, "q_id").groupBy("r_id").agg(F.max_by("vector", "q_id").alias("normal"))
    zero = F.array(*[F.lit(0.0)] * dim)
    out = df.select(id).join(given.withColumnRenamed("r_id", id), id, "left").select(id, F.coalesce("normal", zero).alias("normal"))
    if preferred is not None:
        out = out.withColumn("normal", F.array(*prefer_orientation([F.col("normal")[i] for i in range(dim)], preferred)))
    return out


def _smooth(df: DataFrame, axes: Sequence[str], pairs_of, rounds: int, update: bool, id: str, f: Callable[[str], Column]) -> DataFrame:  # noqa: ANN001
    now = checkpoint(df.select(id, *(F.col(a).cast("double").alias(a) for a in axes)))
    pairs = None
    for _ in range(rounds):
        if pairs is None or update:
            pairs = checkpoint(pairs_of(now).select("q_id", "r_id"))
        moved = pairs.join(now.withColumnRenamed(id, "r_id"), "r_id").groupBy(F.col("q_id").alias(id)).agg(*(f(a).alias(a) for a in axes))
        then = checkpoint(moved)
        drop_checkpoint(now)
        now = then
    return now


def mean_ball(df: DataFrame, axes: Sequence[str], r: float, rounds: int = 1, update: bool = False, id: str = "id", f: Callable[[str], Column] = F.avg) -> DataFrame:
    """Rows moved to the mean (or the aggregate ``f``) of the rows within r, ``rounds`` times; all rows of a round move at once."""
    return _smooth(df, axes, lambda now: joins.ball(now, now, axes, r, id), rounds, update, id, f)


def mean_knn(df: DataFrame, axes: Sequence[str], k: int, rounds: int = 1, update: bool = False, id: str = "id", f: Callable[[str], Column] = F.avg) -> DataFrame:
    """Rows moved to the mean of their k nearest rows (themselves included)."""
    return _smooth(df, axes, lambda now: joins.knn(now, now, axes, k, id), rounds, update, id, f)


def sphere_sums(df: DataFrame, axes: Sequence[str], group: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Normal equations of the algebraic sphere fit by group, about the group's mean."""
    dim = len(axes)
    keys = list(group)
    if keys:
        rows = df.join(df.groupBy(*keys).agg(*(F.avg(a).alias(f"c{i}") for i, a in enumerate(axes))), keys)
    else:
        centre = centre_of(df, axes) or [0.0] * dim
        rows = df.withColumns({f"c{i}": F.lit(float(c)) for i, c in enumerate(centre)})
    # Weights multiply equations, so their squares multiply the sums.
    w = F.col(weight) * F.col(weight) if weight else F.lit(1.0)
    local = [F.col(a) - F.col(f"c{i}") for i, a in enumerate(axes)] + [F.lit(1.0)]
    square = sum((c * c for c in local[1:-1]), local[0] * local[0])
    sums = [F.sum(w * local[i] * local[j]).alias(f"a{i}{j}") for i in range(dim + 1) for j in range(i, dim + 1)]
    right = [F.sum(w * local[i] * square).alias(f"b{i}") for i in range(dim + 1)]
    return rows.groupBy(*keys, *(f"c{i}" for i in range(dim))).agg(*sums, *right, F.sum(w * square * square).alias("bb"), F.count(F.lit(1)).alias("n"))


def fit_spheres(df: DataFrame, axes: Sequence[str], group: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Sphere (circle in 2-D) by group: group columns, n, center (array), radius, residual.

    ``weight`` is a column with one weight per row. Groups whose equations are
    singular (fewer points than needed, points on a line) have a null result.
    """
    dim = len(axes)
    sums = sphere_sums(df, axes, group, weight)
    names = [f"c{i}" for i in range(dim)] + [f"a{i}{j}" for i in range(dim + 1) for j in range(i, dim + 1)] + [f"b{i}" for i in range(dim + 1)] + ["bb"]

    @F.pandas_udf(T.StructType([T.StructField("center", T.ArrayType(T.DoubleType())), T.StructField("radius", T.DoubleType()), T.StructField("residual", T.DoubleType())]))
    def solve(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            rows = []
            for values in zip(*(c.to_numpy(float) for c in columns)):
                centre, upper, b, bb = values[:dim], values[dim:-dim - 2], np.array(values[-dim - 2:-1]), values[-1]
                A = _matrix(upper, dim + 1)
                if not np.isfinite(A).all() or np.linalg.cond(A) > 1e13:
                    rows.append((None, None, None))
                    continue
                p = np.linalg.solve(A, b)
                half = p[:dim] / 2
                rows.append((list(half + np.array(centre)), float(np.sqrt(max(half @ half + p[dim], 0))), float(max(bb - p @ b, 0))))
            yield pd.DataFrame(rows, columns=["center", "radius", "residual"])

    return sums.select(*group, "n", solve(*(F.col(n) for n in names)).alias("_s")).select(*group, "n", "_s.center", "_s.radius", "_s.residual")


def fit_sphere(df: DataFrame, axes: Sequence[str], weight: str | None = None) -> tuple[np.ndarray, float, float] | None:
    """Centre, radius and residual of one sphere through all rows; None if there is none."""
    row = fit_spheres(df, axes, (), weight).first()
    return None if row is None or row["center"] is None else (np.array(row["center"]), row["radius"], row["residual"])


def fit_cylinders(df: DataFrame, axes: Sequence[str], group: Sequence[str], direction: Sequence[float] | None = None, rounds: int = 60) -> DataFrame:
    """Cylinder by group: group columns, origin, vector (unit), radius, residual (mean squared distance).

    Gauss-Newton on the distances to the axis, in one Arrow task per group: a
    group is one object (a stem, a pole), not a whole scan. Starts from
    ``direction`` or the three principal axes and keeps the best.
    """
    names = list(axes)

    def fit(at: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
        centre = at.mean(axis=0)
        p = at - centre
        u = start / np.linalg.norm(start)
        base = np.linalg.svd(u[None, :])[2]
        a, b = base[1], base[2]
        A = np.column_stack([2 * (p @ a), 2 * (p @ b), np.ones(len(p))])
        q = np.linalg.lstsq(A, (p @ a) ** 2 + (p @ b) ** 2, rcond=None)[0]
        origin, radius = q[0] * a + q[1] * b, np.sqrt(max(q[2] + q[0] ** 2 + q[1] ** 2, 1e-12))
        best, damping = np.inf, 1e-3
        for _ in range(rounds):
            base = np.linalg.svd(u[None, :])[2]
            a, b = base[1], base[2]
            d = p - origin
            k = d @ u
            side = d - k[:, None] * u
            dist = np.maximum(np.linalg.norm(side, axis=1), 1e-12)
            n = side / dist[:, None]
            res = dist - radius
            cost = float((res**2).mean())
            if cost > best:  # step back toward steepest descent
                origin, u, radius = kept
                damping *= 10
                if damping > 1e8:
                    break
                continue
            if best - cost < 1e-16 + 1e-12 * best:
                best, kept = cost, (origin, u, radius)
                break
            best, kept, damping = cost, (origin, u, radius), max(damping / 10, 1e-9)
            J = np.column_stack([-n @ a, -n @ b, -k * (n @ a), -k * (n @ b), -np.ones(len(p))])
            step = np.linalg.solve(J.T @ J + damping * np.eye(5), -J.T @ res)
            origin = origin + step[0] * a + step[1] * b
            u = u + step[2] * a + step[3] * b
            u = u / np.linalg.norm(u)
            radius = radius + step[4]
        origin, u, radius = kept
        u = u * (1.0 if u[np.argmax(np.abs(u))] > 0 else -1.0)
        return best, origin + centre, u, abs(float(radius))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        at = rows[names].to_numpy(float)
        key = {g: rows[g].iloc[0] for g in group}
        if len(at) < 6 or not np.isfinite(at).all():
            return pd.DataFrame([key | {"origin": None, "vector": None, "radius": None, "residual": None}])
        starts = [np.asarray(direction, float)] if direction is not None else list(np.linalg.eigh(np.cov(at.T))[1].T)
        cost, origin, u, radius = min((fit(at, s) for s in starts), key=lambda f: f[0])
        return pd.DataFrame([key | {"origin": origin.tolist(), "vector": u.tolist(), "radius": radius, "residual": cost}])

    schema = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group) + ", origin array<double>, vector array<double>, radius double, residual double"
    return df.groupBy(*group).applyInPandas(run, schema)


def lines_of(df: DataFrame, axes: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Line through each group along its main direction: group columns, origin, vector.

    The vector is the principal axis scaled to the farthest projection from the
    centre, which is the origin.
    """
    dim = len(axes)
    mean = df.groupBy(*group).agg(*(F.avg(a).alias(f"_c{i}") for i, a in enumerate(axes)))
    rows = df.join(mean, list(group))
    local = [F.col(a) - F.col(f"_c{i}") for i, a in enumerate(axes)]
    main = group_vectors(rows.select(*group, *(c.alias(f"_d{i}") for i, c in enumerate(local))), group, [F.col(f"_d{i}") for i in range(dim)], -1).select(*group, "vector")
    far = rows.join(main, list(group)).groupBy(*group).agg(F.max(F.abs(scalarproduct(local, [F.col("vector")[i] for i in range(dim)]))).alias("_far"))
    done = mean.join(main, list(group)).join(far, list(group))
    return done.select(*group, F.array(*(F.col(f"_c{i}") for i in range(dim))).alias("origin"), F.transform("vector", lambda v: v * F.col("_far")).alias("vector"))


def line_of(df: DataFrame, axes: Sequence[str]) -> Line | None:
    """The same for all rows, on the driver."""
    row = lines_of(df.withColumn("_g", F.lit(0)), axes, ["_g"]).first()
    return None if row is None else Line(tuple(row["origin"]), tuple(row["vector"]))
