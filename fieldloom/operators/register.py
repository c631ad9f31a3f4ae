"""Registration: affine and rigid fits, joint fits of many sets, and the closest-point iteration."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import affine
from fieldloom.functions.distance import idw
from fieldloom.operators import joins
from fieldloom.session import checkpoint


def _means(pairs: DataFrame, columns: Sequence[str]) -> dict[str, float] | None:
    row = pairs.agg(*(F.avg(c).alias(c) for c in columns)).first()
    return None if row[columns[0]] is None else {c: row[c] for c in columns}


def find_transformation(pairs: DataFrame, a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Least-squares affine matrix that maps the b columns to the a columns of a table of pairs."""
    mean = _means(pairs, [*a, *b])
    if mean is None:
        raise ValueError("no pairs")
    dim = len(a)
    B, A = [F.col(c) - mean[c] for c in b], [F.col(c) - mean[c] for c in a]
    row = pairs.agg(*(F.sum(B[i] * B[j]).alias(f"g{i}{j}") for i in range(dim) for j in range(dim)), *(F.sum(A[i] * B[j]).alias(f"h{i}{j}") for i in range(dim) for j in range(dim))).first()
    G, H = (np.array([[row[f"{n}{i}{j}"] for j in range(dim)] for i in range(dim)]) for n in "gh")
    out = np.eye(dim + 1)
    out[:dim, :dim] = H @ np.linalg.pinv(G)
    out[:dim, -1] = np.array([mean[c] for c in a]) - out[:dim, :dim] @ np.array([mean[c] for c in b])
    return out


def find_rototranslation(pairs: DataFrame, a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Rotation and translation that map the b columns to the a columns best (by singular values; never a reflection)."""
    mean = _means(pairs, [*a, *b])
    if mean is None:
        raise ValueError("no pairs")
    dim = len(a)
    row = pairs.agg(*(F.sum((F.col(b[i]) - mean[b[i]]) * (F.col(a[j]) - mean[a[j]])).alias(f"h{i}{j}") for i in range(dim) for j in range(dim))).first()
    u, _, vt = np.linalg.svd(np.array([[row[f"h{i}{j}"] for j in range(dim)] for i in range(dim)]))
    fix = np.eye(dim)
    fix[-1, -1] = np.sign(np.linalg.det(vt.T @ u.T)) or 1.0
    out = np.eye(dim + 1)
    out[:dim, :dim] = vt.T @ fix @ u.T
    out[:dim, -1] = np.array([mean[c] for c in a]) - out[:dim, :dim] @ np.array([mean[c] for c in b])
    return out


def _jacobian(point: Sequence[Column]) -> list[list[Column | float]]:
    """Change of each axis by a small translation and rotation of the point."""
    if len(point) == 2:
        x, y = point
        return [[1.0, 0.0, -y], [0.0, 1.0, x]]
    x, y, z = point
    return [[1.0, 0.0, 0.0, 0.0, z, -y], [0.0, 1.0, 0.0, -z, 0.0, x], [0.0, 0.0, 1.0, y, -x, 0.0]]


def find_rototranslations(coords: Mapping[str, DataFrame], pairs: DataFrame, axes: Sequence[str], weights: Mapping[str, float | Sequence[float]] | None = None, id: str = "id") -> dict[str, np.ndarray]:
    """Small rotations and translations of several sets that bring the pairs together.

    ``pairs`` has a_set, b_set, a_id, b_id and w. ``weights`` hold sets at their
    places: numbers per unknown (translation, then rotation), relative to the
    number of equations; by default the first set is held. Normal equations of
    all pairs are sums by pair of sets, at most 12 x 12 each; the driver solves
    them. Sets rotate about the mean of their centres. The number of sets is
    small, as each is a table of its own.
    """
    names = list(coords)
    dim = len(axes)
    cols = 3 if dim == 2 else 6
    centres = {}
    for n in names:
        row = coords[n].agg(*(F.avg(a).alias(a) for a in axes)).first()
        centres[n] = np.array([row[a] if row[a] is not None else 0.0 for a in axes])
    middle = np.mean(list(centres.values()), axis=0)
    if weights is None:
        weights = {names[0]: 1.0}
    every = None
    for n in names:
        part = coords[n].select(F.lit(n).alias("_set"), F.col(id).alias("_id"), *((F.col(a) - float(m)).alias(a) for a, m in zip(axes, middle)))
        every = part if every is None else every.unionByName(part)
    every = checkpoint(every)
    side = lambda s: every.select(F.col("_set").alias(f"{s}_set"), F.col("_id").alias(f"{s}_id"), *(F.col(a).alias(f"{s}{i}") for i, a in enumerate(axes)))
    met = pairs.join(side("a"), ["a_set", "a_id"]).join(side("b"), ["b_set", "b_id"])
    A, B = [F.col(f"a{i}") for i in range(dim)], [F.col(f"b{i}") for i in range(dim)]
    ja, jb = _jacobian(A), _jacobian(B)
    flip = [[-v if not isinstance(v, float) or v else 0.0 for v in row] for row in jb]
    rows = [left + right for left, right in zip(ja, flip)]
    w2 = F.col("w") * F.col("w")
    sums = []
    for i in range(2 * cols):
        for j in range(i, 2 * cols):
            terms = [r[i] * r[j] for r in rows if not (isinstance(r[i], float) and r[i] == 0) and not (isinstance(r[j], float) and r[j] == 0)]
            if terms:
                total = terms[0]
                for t in terms[1:]:
                    total = total + t
                sums.append(F.sum(w2 * total).alias(f"g{i}_{j}"))
        right = [r[i] * (b - a) for r, a, b in zip(rows, A, B) if not (isinstance(r[i], float) and r[i] == 0)]
        total = right[0]
        for t in right[1:]:
            total = total + t
        sums.append(F.sum(w2 * total).alias(f"h{i}"))
    parts = met.groupBy("a_set", "b_set").agg(F.count(F.lit(1)).alias("n"), *sums).collect()
    size = cols * len(names)
    N, h, equations = np.zeros((size, size)), np.zeros(size), 0
    for part in parts:
        got = part.asDict()
        place = np.concatenate([np.arange(cols) + names.index(part[s]) * cols for s in ("a_set", "b_set")])
        equations += part["n"] * dim
        for i in range(2 * cols):
            h[place[i]] += got[f"h{i}"]
            for j in range(i, 2 * cols):
                v = got.get(f"g{i}_{j}") or 0.0
                N[place[i], place[j]] += v
                if i != j:
                    N[place[j], place[i]] += v
    for n, w in weights.items():
        hold = np.broadcast_to(np.asarray(w, float), (cols,)) * max(equations, 1)
        at = np.arange(cols) + names.index(n) * cols
        N[at, at] += hold**2
    solved = np.linalg.lstsq(N, h, rcond=None)[0]
    to, back = affine.translation(middle), affine.translation(-middle)
    out = {}
    for i, n in enumerate(names):
        part = solved[i * cols:(i + 1) * cols]
        turn = affine.rotation(part[2] if dim == 2 else part[3:])
        out[n] = to @ affine.translation(part[:dim]) @ turn @ back
    return out


def change_rmse(coords: Mapping[str, DataFrame], axes: Sequence[str], before: Mapping[str, np.ndarray], after: Mapping[str, np.ndarray]) -> float:
    """Largest root mean square movement of a set between two transformations."""
    worst = 0.0
    for n, df in coords.items():
        one, two = affine.transform(axes, before[n]), affine.transform(axes, after[n])
        square = sum(((p - q) * (p - q) for p, q in zip(one[1:], two[1:])), (one[0] - two[0]) * (one[0] - two[0]))
        value = df.agg(F.sqrt(F.avg(square)).alias("r")).first()["r"]
        worst = max(worst, value or 0.0)
    return worst


def icp(
    coords: Mapping[str, DataFrame], axes: Sequence[str], radii: Sequence[float], max_iter: int = 50, max_change_ratio: float = 0.001, matcher: Callable = joins.match_knn,
    overlaps: Mapping[str, Sequence[str]] | None = None, start: Mapping[str, np.ndarray] | None = None, weights: Mapping[str, float | Sequence[float]] | None = None,
    normals: Sequence[str] | None = None, update_normals: bool = False, id: str = "id",
) -> tuple[dict[str, np.ndarray], DataFrame | None, list[float]]:
    """Matching and joint fitting in turn: matrices, last pairs, and the changes of each round.

    ``normals`` names columns that are matched as further axes (``radii`` then
    has twice the length). The loop ends when the largest change is at most the
    length of the radii times ``max_change_ratio``; the matrices from before
    that last round are returned, with its pairs. A round is one matching per
    overlap and one aggregate.
    """
    names = list(coords)
    dim = len(axes)
    if len(radii) != dim * (2 if normals else 1):
        raise ValueError("one radius per matched axis")
    overlaps = overlaps or {a: [b for b in names if b != a] for a in names}
    now = {n: np.asarray((start or {}).get(n, np.eye(dim + 1)), float) for n in names}
    limit = float(np.linalg.norm(radii[:dim])) * max_change_ratio
    match_axes = [*axes, *(normals or [])]
    history: list[float] = []
    pairs: DataFrame | None = None
    for _ in range(max_iter):
        moved = {}
        for n in names:
            columns = dict(zip(axes, affine.transform(axes, now[n])))
            if normals and update_normals:
                turn = now[n].copy()
                turn[:-1, -1] = 0
                columns |= dict(zip(normals, affine.transform(normals, turn)))
            moved[n] = checkpoint(coords[n].withColumns(columns))
        pairs = None
        for a in overlaps:
            for b in overlaps[a]:
                met = matcher(moved[a], moved[b], match_axes, radii, id=id).select("a_id", "b_id")
                left = moved[a].select(F.col(id).alias("a_id"), *(F.col(c).alias(f"_a{i}") for i, c in enumerate(axes)))
                right = moved[b].select(F.col(id).alias("b_id"), *(F.col(c).alias(f"_b{i}") for i, c in enumerate(axes)))
                far = F.sqrt(sum(((F.col(f"_a{i}") - F.col(f"_b{i}")) ** 2 for i in range(1, dim)), (F.col("_a0") - F.col("_b0")) ** 2))
                found = met.join(left, "a_id").join(right, "b_id").select(F.lit(a).alias("a_set"), F.lit(b).alias("b_set"), "a_id", "b_id", idw(far).alias("w"))
                pairs = found if pairs is None else pairs.unionByName(found)
        pairs = checkpoint(pairs)
        then = find_rototranslations(coords, pairs, axes, weights, id)
        history.append(change_rmse(coords, axes, now, then))
        if history[-1] <= limit:
            break
        now = then
    return now, pairs, history
