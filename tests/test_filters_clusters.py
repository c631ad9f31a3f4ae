"""Filters and clusters against literal cases and sequential models."""
# Points and expected results of the plain cases below must stay as they are.

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import cluster, filters, joins
from fieldloom.operators.components import components

AXES = ["x", "y"]


def ids(df):
    return {r["id"] for r in df.collect()}


def test_extrema(frame):
    df = frame([(0, 0), (0, 1), (1, 1), (1, 0), (0.5, 0.5)], a=[2.0, 0.1, 1.0, 0.0, 0.5])
    assert ids(filters.extrema(df, AXES, "a", 1.1)) == {0, 2}
    assert ids(filters.extrema(df, AXES, "a", 1.1, inverse=True)) == {1, 3}
    assert ids(filters.extrema(df, AXES, "a", 1.5, inverse=True)) == {3}
    tied = frame([(0, 0), (1, 0), (2, 0)], a=[1.0, 1.0, 1.0])
    assert ids(filters.extrema(tied, AXES, "a", 1.0)) == {0, 2}


def test_isolation(frame):
    df = frame([(0, 0), (0.5, 0.5), (0, 1), (0.7, 0.5), (-1, -1)])
    assert ids(filters.has_neighbour(df, AXES, 0.7)) == {1, 3}
    assert ids(filters.is_isolated(df, AXES, 0.7)) == {0, 2, 4}


def greedy_model(at, r, order):
    kept, gone = [], set()
    for p in order:
        if p in gone:
            continue
        kept.append(p)
        gone |= {q for q in range(len(at)) if np.hypot(*(np.subtract(at[p], at[q]))) <= r[p]}
    return set(kept)


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_ball(frame, seed):
    rng = np.random.default_rng(seed)
    at = [tuple(map(float, p)) for p in rng.integers(0, 12, (120, 2))]
    order = sorted(range(len(at)), key=lambda i: (at[i][1], i), reverse=True)
    assert ids(filters.greedy_ball(frame(at), AXES, 2.0)) == greedy_model(at, [2.0] * len(at), order)
    radii = [float(v) for v in rng.choice([1.0, 2.5], len(at))]
    assert ids(filters.greedy_ball(frame(at, r=radii), AXES, "r")) == greedy_model(at, radii, order)


def test_surface(frame):
    df = frame([(0, 0), (0.5, 3), (1, 1), (9, 2)])
    assert ids(filters.surface(df, AXES, 2.5)) == {1, 2, 3}


def test_hull(frame):
    df = frame([(0, 0), (0.5, 0.5), (0, 1), (0.7, 0.5), (-1, -1)])
    inside = filters.in_convex_hull(np.array([(0, 0), (1, 0), (1, 2)]), AXES)
    assert [r["i"] for r in df.select("id", inside.alias("i")).orderBy("id").collect()] == [True, True, False, True, False]


def test_dem_filter(frame):
    rng = np.random.default_rng(4)
    ground = [(x * 0.5, y * 0.5, 0.02 * float(rng.random())) for x in range(12) for y in range(12)]
    tree = [(2.6, 2.6, z) for z in (1.0, 2.0, 3.0)]
    got = ids(filters.dem_filter(frame(ground + tree), ["x", "y", "z"], 0.6))
    assert got and not got & {144, 145, 146}


def test_min_filter(frame):
    df = frame([(0, 0), (1, 0), (5, 5)], a=[2.0, 1.0, 7.0])
    assert ids(filters.min_filter(df, AXES, "a", 1.5)) == {1, 2}


SEVEN = [(0, 0), (0, 1), (1, 1), (0, 0.5), (2, 2), (2, 2.5), (19, 29)]


def labels(df):
    return [r["label"] for r in df.orderBy("id").collect()]


def test_dbscan(frame):
    df = frame(SEVEN)
    assert labels(cluster.dbscan(df, AXES, 1, 1.0)) == [0, 0, 0, 0, 1, 1, 2]
    assert labels(cluster.dbscan(df, AXES, 2)) == [0, 0, 0, 0, 0, 0, -1]
    assert labels(cluster.dbscan(df, AXES, 1, quantile=0.7, factor=1)) == [0, 0, 1, 0, 2, 2, 3]


def test_majority_clusters(frame):
    df = frame([(0, 0), (1, 1), (2, 1), (3, 3), (0, 1), (2, 3), (3, 4)])
    assert labels(cluster.majority_clusters(df, AXES, 2.0)) == [1, 1, -1, 0, 1, 0, 0]


def test_weight_clusters(frame):
    at = [(0, 0), (0, 1), (1, 1), (0, 0.5), (2, 2), (2, 2.5), (2.5, 2)]
    df = frame(at, w=[float(i) for i in range(7)])
    first = cluster.weight_clusters(df, AXES, 1.5, df.select("id", F.col("id").alias("label")))
    assert labels(first) == [0, 0, 4, 3, 6, 5, 5]
    assert labels(cluster.weight_clusters(df, AXES, 1.5, first, weights="w")) == [3, 6, 6, 3, 5, 5, 5]


def test_class_operations(spark):
    values = [0, 0, 1, 2, 1, 0, 3, 3, 5, 3, 2, 1, 0]
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, label bigint")
    got = {r["label"]: r["ids"] for r in cluster.class_dict(df).collect()}
    assert got == {0: [0, 1, 5, 12], 1: [2, 4, 11], 2: [3, 10], 3: [6, 7, 9], 5: [8]}
    classes = spark.createDataFrame([(0, [0, 1, 5]), (1, [3, 6]), (2, [7, 2])], "label bigint, ids array<bigint>")
    assert labels(cluster.dict_classes(classes, 9)) == [0, 0, 2, 1, -1, 0, 1, 2, -1]
    parts = spark.range(10).select("id", cluster.split_by_breaks(F.col("id"), [0.5, 5, 7.5]).alias("p")).orderBy("id").collect()
    assert [r["p"] for r in parts] == [0, 1, 1, 1, 1, 2, 2, 2, 3, 3]
    words = spark.createDataFrame([(0, w) for w in "cat dog dog bird cat dog".split()] + [(1, "a"), (1, "b")], "g int, label string")
    assert {r["g"]: r["label"] for r in cluster.majority(words, ["g"], "label", "none").collect()} == {0: "dog", 1: "none"}
    assert [r["label"] for r in cluster.rename_labels(spark.createDataFrame([(0, 40), (1, 7), (2, 40)], "id bigint, label bigint")).orderBy("id").collect()] == [1, 0, 1]


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 340)]
    parent = {v: v for e in edges for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {v: find(v) for v in parent if any(v in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_empty(frame):
    df = frame([(0, 0)]).where("id < 0")
    assert filters.greedy_ball(df, AXES, 1.0).count() == 0
    assert cluster.dbscan(df, AXES, 2, 1.0).count() == 0
    assert cluster.majority_clusters(df, AXES, 1.0).count() == 0
    assert joins.match_pair(df, df, AXES, [1, 1]).count() == 0


def test_clustering_by_function(frame):
    """A line of points: every point takes the smallest label near it, in order of ids."""
    points = [(float(i) * 0.9, 0.0) for i in range(6)] + [(50.0, 0.0), (50.5, 0.0)]
    df = frame(points)
    got = {r.id: r.label for r in cluster.clustering(df, ["x", "y"], 1.0, min, order=F.col("id")).collect()}
    assert got == dict.fromkeys(range(6), 0) | {6: 1, 7: 1}
    seeds = df.where("id in (5, 6)").select("id", (F.col("id") + 10).alias("label"))
    got = {r.id: r.label for r in cluster.clustering(df, ["x", "y"], 1.0, max, order=F.col("id"), seeds=seeds, auto_set=False).collect()}
    assert got[4] == got[5] == 15 and got[6] == got[7] == 16 and got[0] == -1


def test_greedy_walk_over_tiles(spark, monkeypatch):
    """Chains across tiles, crowded tiles and small parts give the plain walk's rows."""
    monkeypatch.setattr(filters, "TILE", 4.0)
    monkeypatch.setattr(filters, "CROWDED", 30)
    monkeypatch.setattr(filters, "EDGES", 100)
    rng = np.random.default_rng(3)
    at = np.concatenate([np.column_stack([np.arange(120) * 0.8, -np.arange(120) * 0.1]), rng.random((300, 2)) * 12, np.tile([[3.0, 3.0]], (40, 1))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "id bigint, x double, y double")
    kept: list[int] = []
    for i in np.lexsort((-np.arange(len(at)), -at[:, 1])):
        if all(((at[i] - at[j]) ** 2).sum() > 1.0 for j in kept):
            kept.append(int(i))
    assert {r.id for r in filters.greedy_ball(df, ["x", "y"], 1.0).collect()} == set(kept)


def crowd(frame, seed):
    """Points on few positions, some of them repeated, in two parts."""
    rng = np.random.default_rng(seed)
    at = np.concatenate([rng.integers(0, 6, (60, 2)), rng.integers(40, 44, (20, 2))]).astype(float)
    return at, frame([tuple(map(float, p)) for p in at])


def test_majority_walk_by_parts(frame, monkeypatch):
    """The walk in memory gives the labels of the rounds, with and without seeds."""
    _, df = crowd(frame, 6)
    seeds = df.where("id % 9 = 0").select("id", (F.col("id") % 4).alias("label"))
    whole = [labels(cluster.majority_clusters(df, AXES, 1.0, order=o, seeds=s)) for o, s in ((None, None), (F.col("x"), seeds))]
    monkeypatch.setattr(cluster, "WALKED", 0)
    assert whole == [labels(cluster.majority_clusters(df, AXES, 1.0, order=o, seeds=s)) for o, s in ((None, None), (F.col("x"), seeds))]


def test_clustering_by_parts(frame, monkeypatch):
    """A function of the labels gives those of the plain walk, in memory and without a round."""
    monkeypatch.setattr(cluster, "_walk_clusters", lambda *a, **k: cluster._walk_parts(a[0], a[1], a[2], a[4], a[5], a[6], None, -1, a[8]))
    at, df = crowd(frame, 7)
    near = [[j for j in range(len(at)) if ((at[i] - at[j]) ** 2).sum() <= 1.0] for i in range(len(at))]
    label, started = [-1] * len(at), []
    for i in sorted(range(len(at)), key=lambda i: (-len(near[i]), -i)):
        seen = [label[j] for j in near[i] if label[j] != -1]
        label[i] = min(seen) if seen else -2 - i
        started += [] if seen else [-2 - i]
    assert labels(cluster.clustering(df, AXES, 1.0, min)) == [started.index(c) for c in label]


def test_weight_walk_without_pairs(frame, monkeypatch):
    """Shared weights over repeated positions give the labels of the plain walk; no pair is made."""
    monkeypatch.setattr(joins, "ball", None)
    at, df = crowd(frame, 8)
    first = df.select("id", F.when(F.col("id") % 5 == 0, F.lit(-1)).otherwise(F.col("id") - F.col("id") % 3).alias("label"))
    near = [[j for j in range(len(at)) if ((at[i] - at[j]) ** 2).sum() <= 1.0] for i in range(len(at))]
    label, weight = [-1 if i % 5 == 0 else i - i % 3 for i in range(len(at))], [1.0] * len(at)
    for i in sorted(range(len(at)), key=lambda i: (-len(near[i]), -i)):
        seen = [label[j] for j in near[i] if label[j] != -1]
        if seen:
            total = {}
            for c in seen:
                total[c] = total.get(c, 0.0) + weight[c]
            best = seen[-1]
            for c, w in total.items():
                best = c if w > total[best] else best
            weight[best], label[i] = total[best] / len(seen), best
    assert labels(cluster.weight_clusters(df, AXES, 1.0, first)) == label


def stacked(spark, monkeypatch):
    """Rows on repeated positions, and the numbers of query rows that radius joins get from here on."""
    rng = np.random.default_rng(9)
    at = np.round(np.concatenate([rng.random((80, 2)) * 9 - 3, np.repeat(rng.random((12, 2)) * 9, 6, axis=0)]), 1)
    value = [float(v) for v in rng.integers(0, 9, len(at))]
    df = spark.createDataFrame([(i, float(x), float(y), v) for i, ((x, y), v) in enumerate(zip(at, value))], "id bigint, x double, y double, a double")
    asked, ball = [], joins.ball

    def counted(queries, refs, *args, **more):
        asked.append(max(queries.count(), refs.count()))
        return ball(queries, refs, *args, **more)

    monkeypatch.setattr(joins, "ball", counted)
    near = ((at[:, None] - at[None]) ** 2).sum(axis=2) <= 1.0
    return at, value, df, near, len(np.unique(at, axis=0)), asked


def test_min_filter_joins_positions_once(spark, monkeypatch):
    _, value, df, near, positions, asked = stacked(spark, monkeypatch)
    assert ids(filters.min_filter(df, AXES, "a", 1.0)) == {min(np.flatnonzero(row), key=lambda j: (value[j], j)) for row in near}
    assert asked == [positions]


def test_greedy_ball_joins_positions_once(spark, monkeypatch):
    at, _, df, near, positions, asked = stacked(spark, monkeypatch)
    kept = []
    for i in sorted(range(len(at)), key=lambda i: (at[i][1], i), reverse=True):
        if not any(near[i, j] for j in kept):
            kept.append(i)
    assert ids(filters.greedy_ball(df, AXES, 1.0)) == set(kept)
    assert asked == [positions]


def test_surface_joins_positions_once(spark, monkeypatch):
    at, _, df, near, positions, asked = stacked(spark, monkeypatch)
    kept = []
    for i in sorted(range(len(at)), key=lambda i: (at[i][1], i), reverse=True):
        if not any(near[i, j] for j in kept):
            kept.append(i)
    got = ids(filters.surface(df, AXES, 1.0))
    assert asked == [positions, positions]
    assert {tuple(at[i]) for i in got} == {tuple(at[max(np.flatnonzero(near[i]), key=lambda j: (at[j][1], j))]) for i in kept}
