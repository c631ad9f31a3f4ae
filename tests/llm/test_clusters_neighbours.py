"""Density peaks and vector neighbours against brute force."""

import numpy as np
import pytest

from fieldloom.llm import clusters, neighbours


def chains(points, radius):
    """Clusters by the smallest id of every chain; points are (id, kind, x, y, z)."""
    label = {p[0]: p[0] for p in points}

    def find(v):
        while label[v] != v:
            v = label[v]
        return v

    for i, p in enumerate(points):
        for q in points[i + 1:]:
            if p[1] == q[1] and sum((a - b) ** 2 for a, b in zip(p[2:], q[2:])) <= radius**2:
                a, b = find(p[0]), find(q[0])
                label[max(a, b)] = min(a, b)
    return {p[0]: find(p[0]) for p in points}


def scan(spark, points):
    return spark.createDataFrame([(*p, "extra") for p in points], "rec_id bigint, classification smallint, x double, y double, z double, density string")


def make(seed, n=260, spread=4.0):
    rng = np.random.default_rng(seed)
    at = rng.random((n, 3)) * spread * np.array([3, 3, 1]) - 3
    at[: n // 3] = at[0] + rng.normal(0, 0.15, (n // 3, 3))  # a third in one place
    return [(int(i) + 1, int(k), *map(float, p)) for i, (k, p) in enumerate(zip(rng.integers(3, 5, n), at))]


def peaks_by_hand(points, radius):
    """Density, nearest denser record and peak of every record; equal positions share them."""
    ids = np.array([p[0] for p in points])
    kind, at = np.array([p[1] for p in points]), np.array([p[2:] for p in points])
    sd = ((at[:, None] - at[None]) ** 2).sum(axis=2)
    sd[kind[:, None] != kind[None]] = np.inf
    density = (sd <= radius**2).sum(axis=1)
    rep = np.array([ids[sd[i] == 0].min() for i in range(len(ids))])
    up = {}
    for i, r in enumerate(rep):
        cand = [(sd[i, j], rep[j]) for j in range(len(ids)) if rep[j] != r and sd[i, j] <= radius**2 and (density[j] > density[i] or density[j] == density[i] and rep[j] < r)]
        up[int(r)] = min(cand) if cand else (None, int(r))

    def peak(r):
        while up[r][1] != r:
            r = up[r][1]
        return r

    return {int(i): (int(d), None if up[int(r)][0] is None else int(up[int(r)][1]), peak(int(r))) for i, r, d in zip(ids, rep, density)}


@pytest.mark.parametrize(("share", "pairs"), [(clusters.SHARE, clusters.PAIRS), (20, 50)])
def test_density_peaks(spark, monkeypatch, share, pairs):
    """Also with tiles cut into shares and pairs of cells taken in parts."""
    monkeypatch.setattr(clusters, "SHARE", share)
    monkeypatch.setattr(clusters, "PAIRS", pairs)
    points = make(3)
    points += [(900, 3, *points[0][2:]), (901, 3, *points[0][2:])]
    want, own = chains(points, 0.6), peaks_by_hand(points, 0.6)
    got = {r.rec_id: r for r in clusters.density_peaks(scan(spark, points)).collect()}
    assert {i: r.cluster_id for i, r in got.items()} == want
    assert {i: (r.density, r.denser, r.peak) for i, r in got.items()} == own
    sizes = {c: list(want.values()).count(c) for c in want.values()}
    assert all(r.size == sizes[r.cluster_id] for r in got.values())
    big = {(r.cluster_id, r.rec_id) for r in clusters.cluster_members(scan(spark, points)).collect()}
    assert big == {(c, i) for i, c in want.items() if sizes[c] >= 8}
    report = clusters.cluster_report(scan(spark, points)).collect()
    assert {r.cluster_id for r in report} == {c for c, n in sizes.items() if n >= 8} and all(len(r.typical) == 3 for r in report)
    assert all(own[r.typical[0]][0] == max(own[i][0] for i, c in want.items() if c == r.cluster_id) for r in report)


def test_hot_positions(spark, monkeypatch):
    """Two positions that hold nearly all rows are joined once, however many rows they have."""
    monkeypatch.setattr(clusters.skewed_join, "__defaults__", (1000,))
    n = 20000
    df = spark.range(2 * n + 5).selectExpr("id as rec_id", "3S as classification", f"case when id < {n} then 0.0D when id < {2 * n} then 0.5D else 100.0D + id end as x", "0.0D as y", "0.0D as z")
    seen = []
    count = clusters._count_near
    monkeypatch.setattr(clusters, "_tiles", lambda places, *rest, tiles=clusters._tiles: seen.append(places.count()) or tiles(places, *rest))
    got = clusters.density_peaks(df).groupBy("cluster_id", "size", "density", "peak").count().collect()
    assert seen == [7, 7] and count is clusters._count_near
    assert sorted(map(tuple, got))[0] == (0, 2 * n, 2 * n, 0, 2 * n) and len(got) == 6


def test_strays_and_nulls(spark):
    points = [(1, 3, 0.0, 0.0, 0.0), (2, 3, 0.0, 0.0, 0.5), (3, 3, 9e11, -9e11, 9e11), (4, 3, None, 0.0, 0.0), (5, None, 0.0, 0.0, 0.0), (6, 2, 0.0, 0.0, 0.0), (7, 3, float("nan"), 0.0, 0.0), (8, 3, float("inf"), 0.0, 0.0)]
    got = {r.rec_id: r.cluster_id for r in clusters.density_peaks(scan(spark, points)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    assert clusters.cluster_members(scan(spark, points).where("rec_id > 99")).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "extra") for i, v in rows], "vec_id bigint, coords array<double>, rep string")


def brute(rows, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows])
    out = {}
    for i, v in rows:
        d = ((x - v) ** 2).sum(axis=1)
        d[ids == i] = np.inf
        out[i] = [int(j) for j in ids[np.lexsort((ids, d))][: min(k, len(rows) - 1)]]
    return out


@pytest.mark.parametrize("spread", [0.5, 40.0])
def test_neighbours(spark, monkeypatch, spread):
    """Clustered and scattered vectors, equal ones (a third of all) and ties."""
    monkeypatch.setattr(neighbours, "HOT", 40)
    rng = np.random.default_rng(7)
    centre = rng.normal(0, 30, (25, 12))
    at = (centre[rng.integers(0, 25, 300)] + rng.normal(0, spread, (300, 12))).round(3)
    at[:100] = at[0]
    rows = [(int(i) * 3 + 1, list(map(float, v))) for i, v in enumerate(at)]
    bad = [(2, None), (5, []), (8, [1.0] * 11), (11, [1.0] * 11 + [None]), (14, [1.0] * 11 + [float("nan")]), (17, [1.0] * 13), (20, [float("inf")] * 12)]
    got = {r.vec_id: [c.id for c in r.neighbours] for r in neighbours.neighbour_lists(vectors(spark, rows + bad)).collect()}
    assert got == brute(rows)


def test_boxes_hold_all_nearer_vectors():
    """A vector within the distance lies in a probed bucket of one of the substrings."""
    rng = np.random.default_rng(12)
    x = rng.normal(0, 5, (500, 12))
    code = neighbours.Code.learn(x, 200000)
    level, _ = code.encode(x)
    for far in (4.0, 60.0):
        bound = np.full(40, far)
        got = [set(), set()]
        for half in (0, 1):
            rows, keys, over = code.near_boxes(x[:40], half, bound / 2, most=10**6)
            assert not over.any()
            got[half] = set(zip(rows.tolist(), keys.tolist()))
        sd = ((x[:40, None] - x[None]) ** 2).sum(axis=2)
        for i, j in zip(*np.nonzero(sd <= far)):
            assert any((i, int(code.key(level[j:j + 1], h)[0])) in got[h] for h in (0, 1))
    rows, _, over = code.near_boxes(x[:40], 0, np.full(40, 1e6), most=100)
    assert over.all() and not len(rows)


def test_too_many_boxes_go_to_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST", 2)
    monkeypatch.setattr(neighbours.Code.near_boxes, "__defaults__", (2,))
    rng = np.random.default_rng(3)
    rows = [(i, list(map(float, v))) for i, v in enumerate(rng.normal(0, 9, (120, 12)))]
    assert {r.vec_id: [c.id for c in r.neighbours] for r in neighbours.neighbour_lists(vectors(spark, rows)).collect()} == brute(rows)


def test_few_vectors(spark):
    assert neighbours.nearest_pairs(vectors(spark, [])).count() == 0
    assert neighbours.nearest_pairs(vectors(spark, [(1, [0.0] * 12)])).count() == 0
    pairs = {(r.vec_a, r.vec_b) for r in neighbours.nearest_pairs(vectors(spark, [(i, [float(i)] * 12) for i in range(3)])).collect()}
    assert pairs == {(0, 1), (0, 2), (1, 2)}


def test_probes_cover_the_radius():
    """Pigeonhole: codes that differ in at most 2s + 1 bits share a substring within s."""
    rng = np.random.default_rng(2)
    x = rng.normal(0, 20, (400, 12))
    code = neighbours.Code.learn(x, 5000)
    level, cost = code.encode(x)
    assert (cost[:, 1:] >= cost[:, :-1]).all()
    for near in (1, 2):
        found = {half: {} for half in (0, 1)}
        for half in (0, 1):
            keys = code.key(level, half)
            rows, probed = code.probes(level, half, near)
            for r, p in zip(rows, probed):
                found[half].setdefault(int(r), set()).add(int(p))
            assert all(int(keys[r]) in s for r, s in found[half].items())
        for i in range(60):
            apart = np.abs(level - level[i]).sum(axis=1)
            for j in np.flatnonzero(apart <= 2 * near + 1):
                assert any(int(code.key(level[j:j + 1], h)[0]) in found[h][i] for h in (0, 1))
                # The cost is never more than the true squared distance.
                if apart[j]:
                    assert cost[i, apart[j] - 1] <= ((x[i] - x[j]) ** 2).sum() + 1e-9
