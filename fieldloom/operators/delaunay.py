"""Delaunay triangulation of a bounded set of points in the plane, in whole numbers, and the search of points in it."""

from __future__ import annotations

import numpy as np

#: Steps along the larger side of the box of the points; tests in whole numbers of them are exact.
STEPS = 2.0**40
#: Pairs of a point and a triangle that are weighed at once, and entries of triangles in cells.
PAIRS = 1_000_000
ENTRIES = 8_000_000


def _turn(ax: int, ay: int, bx: int, by: int, cx: int, cy: int) -> int:
    """Positive where c lies to the left of the way from a to b."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _insertion_order(at: np.ndarray) -> np.ndarray:
    """Rounds of doubling size drawn by a fixed seed, each along a curve, so that the next point is near the last."""
    n = len(at)
    drawn = np.random.default_rng(0).permutation(n)
    code = np.zeros(n, np.int64)
    cell = np.minimum(at / STEPS * 1024, 1023).astype(np.int64)
    for bit in range(10):
        code |= ((cell[:, 0] >> bit & 1) << (2 * bit)) | ((cell[:, 1] >> bit & 1) << (2 * bit + 1))
    out, lo = [], 0
    while lo < n:
        hi = min(n, max(64, 2 * lo))
        part = drawn[lo:hi]
        out.append(part[np.argsort(code[part], kind="stable")])
        lo = hi
    return np.concatenate(out)


def triangulate(points: np.ndarray) -> np.ndarray:
    """Triangles (rows of three indices) by incremental insertion; the hull is closed by triangles to a point at infinity.

    Each point is found by a walk from the last one, and the triangles whose
    circumcircles hold it, which hang together, make room for it. Positions are
    rounded to 2**-40 of the box, so that all tests are exact; repeated
    positions count once and points on one line give no triangles.
    """
    points = np.asarray(points, float)
    if not len(points):
        return np.empty((0, 3), int)
    low = points.min(axis=0)
    span = max(float((points.max(axis=0) - low).max()), 1e-300)
    steps = np.round((points - low) / span * STEPS).astype(np.int64)
    at, first = np.unique(steps, axis=0, return_index=True)
    if len(first) < 3:
        return np.empty((0, 3), int)
    order = _insertion_order(at.astype(float)).tolist()
    X, Y = at[:, 0].tolist(), at[:, 1].tolist()
    p0, p1 = order[0], order[1]
    third = next((i for i in range(2, len(order)) if _turn(X[p0], Y[p0], X[p1], Y[p1], X[order[i]], Y[order[i]])), None)
    if third is None:
        return np.empty((0, 3), int)
    p2 = order.pop(third)
    if _turn(X[p0], Y[p0], X[p1], Y[p1], X[p2], Y[p2]) < 0:
        p0, p1 = p1, p0
    # Corners of triangles, counter-clockwise, and the neighbours opposite to them; the point at infinity is -1 and comes last.
    corner = [(p0, p1, p2), (p1, p0, -1), (p2, p1, -1), (p0, p2, -1)]
    beside = [[2, 3, 1], [3, 2, 0], [1, 3, 0], [2, 1, 0]]
    last, unused = 0, []

    def holds(t: int, x: int, y: int) -> bool:
        a, b, c = corner[t]
        ax, ay, bx, by = X[a] - x, Y[a] - y, X[b] - x, Y[b] - y
        if c < 0:
            side = ax * by - ay * bx
            return side > 0 or (side == 0 and ax * bx + ay * by < 0)
        cx, cy = X[c] - x, Y[c] - y
        return (ax * ax + ay * ay) * (bx * cy - by * cx) - (bx * bx + by * by) * (ax * cy - ay * cx) + (cx * cx + cy * cy) * (ax * by - ay * bx) > 0

    for p in order[2:]:
        x, y = X[p], Y[p]
        t = last
        while True:
            a, b, c = corner[t]
            if c < 0:
                break
            if _turn(X[a], Y[a], X[b], Y[b], x, y) < 0:
                t = beside[t][2]
            elif _turn(X[b], Y[b], X[c], Y[c], x, y) < 0:
                t = beside[t][0]
            elif _turn(X[c], Y[c], X[a], Y[a], x, y) < 0:
                t = beside[t][1]
            else:
                break
        hollow, open_, border = {t}, [t], []
        while open_:
            s = open_.pop()
            v = corner[s]
            for i in (0, 1, 2):
                o = beside[s][i]
                if o in hollow:
                    continue
                if holds(o, x, y):
                    hollow.add(o)
                    open_.append(o)
                else:
                    border.append((v[(i + 1) % 3], v[(i + 2) % 3], o))
        unused.extend(hollow)
        leaving, arriving = {}, {}
        for a, b, o in border:
            if unused:
                t = unused.pop()
            else:
                t = len(corner)
                corner.append((0, 0, 0))
                beside.append([0, 0, 0])
            # The edge from a to b with p; infinity is turned to the last place. Then the places of p, a and b.
            if a < 0:
                corner[t], out, left, right = (b, p, -1), 1, 2, 0
            elif b < 0:
                corner[t], out, left, right = (p, a, -1), 0, 1, 2
            else:
                corner[t], out, left, right = (a, b, p), 2, 0, 1
                last = t
            beside[t][out] = o
            v = corner[o]
            for i in (0, 1, 2):
                if v[(i + 1) % 3] == b and v[(i + 2) % 3] == a:
                    beside[o][i] = t
            leaving[a] = (t, right)
            arriving[b] = (t, left)
        for w, (t, i) in leaving.items():
            s, j = arriving[w]
            beside[t][i] = s
            beside[s][j] = t
    free = set(unused)
    out = np.array([v for t, v in enumerate(corner) if v[2] >= 0 and t not in free], int).reshape(-1, 3)
    return first[out]


def _ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number of the ranges, and which range it is of."""
    of = np.repeat(np.arange(len(count)), count)
    return np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + start[of], of


def barycentric(points: np.ndarray, triangles: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triangle (or -1) and barycentric weights of each query point; triangles are looked up by the cells of their boxes."""
    where = np.full(len(queries), -1)
    weight = np.full((len(queries), 3), np.nan)
    if not len(triangles) or not len(queries):
        return where, weight
    points, queries = np.asarray(points, float), np.asarray(queries, float)
    corners = points[triangles]
    low, high = corners.min(axis=1), corners.max(axis=1)
    rim = (high - low).max(axis=1, keepdims=True) * 1e-8
    low, high = low - rim, high + rim
    start, end = low.min(axis=0), high.max(axis=0)
    side = max(1, int((len(triangles) / 2) ** 0.5))
    while True:
        edge = np.maximum(end - start, 1e-300) / side
        c0 = np.clip(np.floor((low - start) / edge).astype(np.int64), 0, side - 1)
        c1 = np.clip(np.floor((high - start) / edge).astype(np.int64), 0, side - 1)
        wide, tall = (c1 - c0 + 1).T
        if side == 1 or (wide * tall).sum() <= max(ENTRIES, 2 * len(triangles)):
            break
        side //= 2
    number, of = _ranges(np.zeros(len(triangles), np.int64), wide * tall)
    cell = (c0[of, 0] + number % wide[of]) * side + c0[of, 1] + number // wide[of]
    by = np.argsort(cell, kind="stable")
    cell, of = cell[by], of[by]
    inside = np.flatnonzero(((queries >= start) & (queries <= end)).all(axis=1))
    q = np.minimum(np.floor((queries[inside] - start) / edge).astype(np.int64), side - 1)
    mine = q[:, 0] * side + q[:, 1]
    begin = np.searchsorted(cell, mine)
    count = np.searchsorted(cell, mine, side="right") - begin
    a, b, c = corners[:, 0], corners[:, 1], corners[:, 2]
    d = (b[:, 1] - c[:, 1]) * (a[:, 0] - c[:, 0]) + (c[:, 0] - b[:, 0]) * (a[:, 1] - c[:, 1])
    total = np.cumsum(count)
    lo = 0
    while lo < len(inside):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, side="right")))
        entry, row = _ranges(begin[lo:hi], count[lo:hi])
        t = of[entry]
        rows = inside[lo:hi][row]
        lo = hi
        dx, dy = queries[rows, 0] - c[t, 0], queries[rows, 1] - c[t, 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            w0 = ((b[t, 1] - c[t, 1]) * dx + (c[t, 0] - b[t, 0]) * dy) / d[t]
            w1 = ((c[t, 1] - a[t, 1]) * dx + (a[t, 0] - c[t, 0]) * dy) / d[t]
        least = np.minimum(np.minimum(w0, w1), 1 - w0 - w1)
        ok = np.isfinite(least) & (least >= -1e-9)
        rows, t, least, w0, w1 = rows[ok], t[ok], least[ok], w0[ok], w1[ok]
        # The last of a row in this order is its best: the largest least weight, of equals the first triangle.
        by = np.lexsort((-t, least, rows))
        best = by[np.append(rows[by][1:] != rows[by][:-1], True)] if len(by) else by
        where[rows[best]] = t[best]
        weight[rows[best]] = np.column_stack([w0[best], w1[best], 1 - w0[best] - w1[best]])
    return where, weight
