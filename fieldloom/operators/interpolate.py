"""Interpolation of values at query points from reference points."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import joins
from fieldloom.operators.delaunay import barycentric, triangulate
from fieldloom.operators.estimate import centre_of
from fieldloom.session import checkpoint


def knn_interpolate(queries: DataFrame, refs: DataFrame, axes: Sequence[str], value: str, k: int | None = None, max_dist: float | None = None, id: str = "id", ref_id: str | None = None) -> DataFrame:
    """Mean of the k nearest values weighted by 1/d: q_id, value.

    k is one more than the dimensions by default. References at distance 0
    decide alone. Beyond ``max_dist`` a reference has no weight; a query without
    any has a null value. References of null value are left out.
    """
    known = refs.where(F.col(value).isNotNull())
    # Queries at one position have the same value, so each position is asked once.
    at = [f"_x{i}" for i in range(len(axes))]
    every = joins.points(queries, axes, id, "q_").withColumnsRenamed({f"q_{i}": a for i, a in enumerate(at)})
    asked = checkpoint(every.groupBy(*at).agg(F.min("q_id").alias("_first")))
    near = joins.knn(asked.select(F.col("_first").alias(id), *(F.col(x).alias(a) for x, a in zip(at, axes))), known, axes, k or len(axes) + 1, id, ref_id)
    values = known.select(F.col(ref_id or id).alias("r_id"), F.col(value).cast("double").alias("_v"))
    d = F.sqrt("sd")
    weight = F.when(d == 0, F.lit(0.0)).when((d > max_dist) if max_dist is not None else F.lit(False), F.lit(0.0)).otherwise(1 / F.nullif(d, F.lit(0.0)))
    met = near.join(values, "r_id").withColumn("_w", weight)
    exact, total = F.avg(F.when(d == 0, F.col("_v"))), F.sum("_w")
    value_of = met.groupBy(F.col("q_id").alias("_first")).agg(F.coalesce(exact, F.try_divide(F.sum(F.col("_w") * F.col("_v")), total)).alias("value"))
    return every.join(asked.join(value_of, "_first").select(*at, "value"), at).select("q_id", "value")


def powers(dim: int, degree: int, interaction_only: bool = False) -> list[tuple[int, ...]]:
    """Axes multiplied in each term of a polynomial, without the constant."""
    terms = [t for d in range(1, degree + 1) for t in combinations_with_replacement(range(dim), d)]
    return [t for t in terms if not interaction_only or len(set(t)) == len(t)]


class Polynomial:
    """A fitted polynomial: an expression over axis columns, centred for stability."""

    def __init__(self, centre: Sequence[float], terms: list[tuple[int, ...]], coef: np.ndarray, intercept: float) -> None:
        self.centre, self.terms, self.coef, self.intercept = list(centre), terms, coef, intercept

    def __call__(self, *axes: Column | str) -> Column:
        local = [(F.col(a) if isinstance(a, str) else a) - c for a, c in zip(axes, self.centre, strict=True)]
        total = F.lit(float(self.intercept))
        for term, c in zip(self.terms, self.coef):
            part = F.lit(float(c))
            for axis in term:
                part = part * local[axis]
            total = total + part
        return total


def fit_polynomial(refs: DataFrame, axes: Sequence[str], value: str, degree: int = 2, weight: str | None = None, interaction_only: bool = False) -> Polynomial:
    """Least squares polynomial from the sums of products of its terms: two aggregates, one small solve."""
    known = refs.where(F.col(value).isNotNull())
    for a in axes:
        known = known.where(F.col(a).isNotNull())
    centre = centre_of(known, axes)
    if centre is None:
        raise ValueError("no rows to fit")
    terms = powers(len(axes), degree, interaction_only)
    columns = [F.lit(1.0)]
    for term in terms:
        part = F.lit(1.0)
        for axis in term:
            part = part * (F.col(axes[axis]) - centre[axis])
        columns.append(part)
    w = F.col(weight) if weight else F.lit(1.0)
    n = len(columns)
    sums = [F.sum(w * columns[i] * columns[j]).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)]
    row = known.agg(*sums, *(F.sum(w * columns[i] * F.col(value)).alias(f"b{i}") for i in range(n))).first()
    A = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            A[i, j] = A[j, i] = row[f"a{i}_{j}"]
    solved = np.linalg.lstsq(A, np.array([row[f"b{i}"] for i in range(n)]), rcond=None)[0]
    return Polynomial(centre, terms, solved[1:], float(solved[0]))


def linear_interpolate(queries: DataFrame, refs: DataFrame, axes: Sequence[str], values: Sequence[str], tile: float, id: str = "id") -> DataFrame:
    """Values by barycentric weights in a Delaunay triangulation: q_id and the values; null outside.

    The triangulation is made by tiles of edge ``tile`` with a rim of one tile
    around; it equals the one of all points where circumcircles are smaller than
    the rim, so ``tile`` should be many times the distance of neighbours. Two
    axes. A tile is one task. Reference rows at one position count once, with
    the lowest values.
    """
    x, y = axes
    q = joins.points(queries, axes, id, "q_").withColumns({"_tx": F.floor(F.col("q_0") / tile), "_ty": F.floor(F.col("q_1") / tile)})
    known = refs
    for v in (*axes, *values):
        known = known.where(F.col(v).isNotNull())
    for a in axes:
        known = known.where(~F.isnan(F.col(a).cast("double")))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    r = known.select(F.col(x).cast("double").alias("r_0"), F.col(y).cast("double").alias("r_1"), *(F.col(v).cast("double").alias(v) for v in values))
    r = r.groupBy("r_0", "r_1").agg(F.min(F.struct(*values)).alias("_v")).select("r_0", "r_1", "_v.*")
    r = r.withColumn("_i", F.explode(around)).withColumn("_j", F.explode(around)).withColumns({"_tx": F.floor(F.col("r_0") / tile) + F.col("_i"), "_ty": F.floor(F.col("r_1") / tile) + F.col("_j")}).drop("_i", "_j")
    r = r.join(q.select("_tx", "_ty").distinct(), ["_tx", "_ty"], "left_semi")
    names = list(values)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"q_id": left["q_id"].to_numpy()} | {v: np.full(len(left), np.nan) for v in names}
        at = right[["r_0", "r_1"]].to_numpy(float)
        if len(at) >= 3 and len(left):
            triangles = triangulate(at)
            where, weight = barycentric(at, triangles, left[["q_0", "q_1"]].to_numpy(float))
            ok = where >= 0
            for v in names:
                corner = right[v].to_numpy(float)[triangles[where[ok]]]
                out[v][ok] = (corner * weight[ok]).sum(axis=1)
        return pd.DataFrame(out)

    schema = f"q_id {q.schema['q_id'].dataType.simpleString()}, " + ", ".join(f"`{v}` double" for v in names)
    found = q.groupBy("_tx", "_ty").cogroup(r.groupBy("_tx", "_ty")).applyInPandas(run, schema)
    return found.select("q_id", *(F.when(~F.isnan(v), F.col(v)).alias(v) for v in names))


def surface(refs: DataFrame, axes: Sequence[str], k: int | None = None):  # noqa: ANN201
    """The last axis as a surface over the others: a function that adds its height to a table with ids."""
    flat, up = list(axes[:-1]), axes[-1]

    def height(df: DataFrame, x: str, y: str, out: str) -> DataFrame:
        asked = df.select("id", F.col(x).alias(flat[0]), F.col(y).alias(flat[1]))
        got = knn_interpolate(asked, refs, flat, up, k, ref_id="id")
        return df.join(got.select(F.col("q_id").alias("id"), F.col("value").alias(out)), "id", "left")

    return height


class Interpolator:
    """One interface to all kinds: fitted to reference rows, called with query rows, gives (q_id, value).

    ``kind`` is knn (k, max_dist), polynomial (degree, weight, interaction_only)
    or linear (tile); options go to the function of that kind.
    """

    def __init__(self, kind: str, refs: DataFrame, axes: Sequence[str], value: str, id: str = "id", **options: object) -> None:
        if kind not in ("knn", "polynomial", "linear"):
            raise ValueError(f"no interpolation of kind {kind}")
        self.kind, self.refs, self.axes, self.value, self.id, self.options = kind, refs, list(axes), value, id, options
        self.fit = fit_polynomial(refs, self.axes, value, **options) if kind == "polynomial" else None

    @property
    def dim(self) -> int:
        return len(self.axes)

    def __call__(self, queries: DataFrame) -> DataFrame:
        """Values at the queries' axes; queries of missing coordinates have none."""
        if self.kind == "polynomial":
            return queries.select(F.col(self.id).alias("q_id"), self.fit(*self.axes).alias("value"))
        if self.kind == "knn":
            return knn_interpolate(queries, self.refs, self.axes, self.value, id=self.id, **self.options)
        return linear_interpolate(queries, self.refs, self.axes, [self.value], id=self.id, **self.options).select("q_id", F.col(self.value).alias("value"))
