"""Estimators, interpolation and registration."""
# Points and expected results of the plain cases below must stay as they are.

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import affine
from fieldloom.operators import estimate, interpolate, register
from fieldloom.operators.delaunay import barycentric, triangulate

AXES = ["x", "y"]


def test_eigen(frame):
    at = np.random.default_rng(1).normal(0, [3, 1], (200, 2))
    df = frame([tuple(map(float, p + [5e5, 5e6])) for p in at])
    vectors, values = estimate.eigen(df, AXES)
    want = np.linalg.eigvalsh((at - at.mean(0)).T @ (at - at.mean(0)))[::-1]
    assert np.allclose(values, want)
    assert abs(vectors[0, 0]) > 0.9
    T, _ = estimate.pca(df, AXES)
    ratio = estimate.explained_variance(df, AXES, T).first()
    assert ratio.ratio_0 + ratio.ratio_1 == pytest.approx(1) and ratio.ratio_0 > ratio.ratio_1


def test_normals(frame):
    df = frame([(0, 0), (1, 1), (2, 2), (9, 9)])
    got = [r["normal"] for r in estimate.fit_normals(df, AXES, 1.5).orderBy("id").collect()]
    assert np.allclose(np.abs(got[1]), math.sqrt(0.5)) and got[1][0] * got[1][1] < 0 and got[3] == [0, 0]
    turned = estimate.fit_normals(df, AXES, 1.5, preferred=[0, 1]).orderBy("id").collect()
    assert turned[1]["normal"][1] > 0 and turned[3]["normal"] == [0, 1]
    near = estimate.fit_normals(df, AXES, k=2).orderBy("id").collect()
    assert near[0]["normal"][0] * near[0]["normal"][1] < 0
    with pytest.raises(ValueError):
        estimate.fit_normals(df, AXES, k=1)
    spread = [r["normal"] for r in estimate.approximate_normals(df, AXES, 1.5).orderBy("id").collect()]
    assert spread[0] == spread[1] and spread[3] == [0, 0]
    unit = frame([(3, 4), (0, 0)]).select("id", *(c.alias(f"v{i}") for i, c in enumerate(estimate.normalize(AXES)))).orderBy("id").collect()
    assert (unit[0].v0, unit[0].v1, unit[1].v0) == (pytest.approx(0.6), pytest.approx(0.8), 0)


def test_smoothing(frame):
    at = [(0.0, 0.0), (1.0, 0.4), (2.0, 0.0), (9.0, 9.0)]
    got = estimate.mean_ball(frame(at), AXES, 1.5).orderBy("id").collect()
    assert np.allclose([(r.x, r.y) for r in got], [(0.5, 0.2), (1, 0.4 / 3), (1.5, 0.2), (9, 9)])
    twice = estimate.mean_ball(frame(at), AXES, 1.5, rounds=2, update=True)
    assert twice.count() == 4
    assert estimate.mean_knn(frame(at), AXES, 1).orderBy("id").collect()[1].x == 1


def test_spheres_and_cylinders(frame):
    a = np.linspace(0, 2 * np.pi, 20, endpoint=False)
    df = frame([(2 + 5 * np.cos(v), 4 + 5 * np.sin(v)) for v in a], g=[1] * 20)
    centre, r, rest = estimate.fit_sphere(df, AXES)
    assert np.allclose(centre, [2, 4]) and r == pytest.approx(5) and rest == pytest.approx(0, abs=1e-6)
    line = frame([(float(i), float(i)) for i in range(5)], g=[1] * 5)
    assert estimate.fit_sphere(line, AXES) is None
    tube = frame([(1 + 2.5 * np.cos(v), 2 + 2.5 * np.sin(v), h) for v in a for h in (0.0, 1.0, 2.0, 5.0)], g=[7] * 80)
    got = estimate.fit_cylinders(tube, ["x", "y", "z"], ["g"]).first()
    assert got.radius == pytest.approx(2.5, abs=1e-3) and abs(got.vector[2]) == pytest.approx(1, abs=1e-3)
    stem = frame([(0, 0, float(h)) for h in range(5)], g=[1] * 5)
    row = estimate.lines_of(stem, ["x", "y", "z"], ["g"]).first()
    assert np.allclose(row.origin, [0, 0, 2]) and np.allclose(row.vector, [0, 0, 2])


def test_interpolators(frame):
    refs = frame([(0, 0), (0, 2), (2, 1)], v=[0.0, 3.0, 6.0])
    asked = frame([(0, 1), (0, 0), (0, -1)])
    got = interpolate.linear_interpolate(asked, refs, AXES, ["v"], 10.0).orderBy("q_id").collect()
    assert got[0].v == pytest.approx(1.5) and got[1].v == pytest.approx(0) and got[2].v is None
    near = interpolate.knn_interpolate(asked, refs, AXES, "v", 2).orderBy("q_id").collect()
    assert near[0].value == pytest.approx(1.5) and near[1].value == 0
    far = interpolate.knn_interpolate(frame([(50, 50)]), refs, AXES, "v", 2, max_dist=1.0).first()
    assert far.value is None
    at = [(float(x), float(y)) for x in range(4) for y in range(4)]
    poly = interpolate.fit_polynomial(frame(at, v=[1 + 2 * x - y + x * y for x, y in at]), AXES, "v", 2)
    assert frame([(5, 7)]).select(poly("x", "y").alias("v")).first()["v"] == pytest.approx(1 + 10 - 7 + 35)
    with pytest.raises(ValueError):
        interpolate.fit_polynomial(refs.where("id < 0"), AXES, "v")


def test_triangulation():
    at = np.random.default_rng(3).random((120, 2))
    tri = triangulate(at)
    a, b, c = at[tri[:, 0]], at[tri[:, 1]], at[tri[:, 2]]
    area = np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])) / 2
    for t in tri[:40]:  # no point lies within a circumcircle
        p, q, r = at[t]
        m = np.array([q - p, r - p]) * 2
        u = np.linalg.solve(m, [(q - p) @ (q - p), (r - p) @ (r - p)])
        d = ((at - p - u) ** 2).sum(axis=1)
        assert (d >= (u @ u) * (1 - 1e-7)).all()
    assert area.sum() > 0.8
    assert len(triangulate(np.array([[0, 0], [1, 1], [2, 2]]))) == 0 and len(triangulate(np.zeros((1, 2)))) == 0
    where, weight = barycentric(np.array([[0, 0], [2, 0], [0, 2]]), np.array([[0, 1, 2]]), np.array([[0.5, 0.5], [3, 3]]))
    assert where.tolist() == [0, -1] and np.allclose(weight[0], [0.5, 0.25, 0.25])


def test_fits(spark):
    rng = np.random.default_rng(6)
    b = rng.random((30, 3)) * 10
    turn = affine.compose(t=[1, 2, 3], r=[0.1, -0.2, 0.3])
    a = affine.apply(turn, b)
    pairs = spark.createDataFrame([tuple(map(float, (*p, *q))) for p, q in zip(a, b)], ", ".join(f"a{i} double" for i in range(3)) + ", " + ", ".join(f"b{i} double" for i in range(3)))
    names = [f"a{i}" for i in range(3)], [f"b{i}" for i in range(3)]
    assert np.allclose(register.find_rototranslation(pairs, *names), turn)
    assert np.allclose(register.find_transformation(pairs, *names), turn)
    mirrored = pairs.withColumn("a2", -F.col("a2"))
    assert np.linalg.det(register.find_rototranslation(mirrored, *names)[:3, :3]) == pytest.approx(1)


def test_icp(frame):
    rng = np.random.default_rng(8)
    at = rng.random((40, 2)) * 20
    moved = affine.apply(affine.compose(t=[0.2, -0.1], r=0.01), at)
    found, pairs, history = register.icp({"a": frame([tuple(map(float, p)) for p in at]), "b": frame([tuple(map(float, p)) for p in moved])}, AXES, [1.0, 1.0], max_iter=6)
    assert np.abs(affine.apply(found["b"], moved) - affine.apply(found["a"], at)).max() < 0.05
    assert pairs.count() > 60 and history[-1] < history[0]
    with pytest.raises(ValueError):
        register.icp({}, AXES, [1.0])


def test_interpolators(frame):
    """All kinds reproduce a plane at points between its own, through one interface."""
    from fieldloom.operators.interpolate import Interpolator  # noqa: PLC0415

    at = [(float(i % 6), float(i // 6)) for i in range(36)]
    refs = frame(at, v=[1.0 + x + 2 * y for x, y in at])
    asked = frame([(1.5, 2.5), (3.25, 0.75)])
    for kind, options, off in (("polynomial", {"degree": 2}, 1e-6), ("linear", {"tile": 50.0}, 1e-6), ("knn", {"k": 4}, 0.6)):
        made = Interpolator(kind, refs, ["x", "y"], "v", **options)
        got = {r.q_id: r.value for r in made(asked).collect()}
        assert made.dim == 2 and abs(got[0] - 7.5) <= off and abs(got[1] - 5.75) <= off, kind
    with pytest.raises(ValueError):
        Interpolator("spline", refs, ["x", "y"], "v")


def test_triangulate_regular_grid():
    """Four points on a circle everywhere: the squares are halved, none twice, and points are found in one of the halves."""
    at = np.array([(x, 900 + y / 10) for x in range(20) for y in range(20)], float)
    triangles = triangulate(np.vstack([at, at]))
    assert len(triangles) == 2 * 19 * 19
    where, weight = barycentric(at, triangles, np.vstack([at + [0.5, 0.025], [[-1.0, 900.0]]]))
    inside = (at[:, 0] < 19) & (at[:, 1] < 901.85)
    assert (where[:-1] >= 0).tolist() == inside.tolist() and where[-1] == -1
    got = (at[triangles[where[:-1][inside]]] * weight[:-1][inside][:, :, None]).sum(axis=1)
    assert np.allclose(got, at[inside] + [0.5, 0.025])


def test_linear_interpolate_repeated_references(spark, frame):
    """Of reference rows at one position the lowest values count, whatever their order; a row without a position does no harm."""
    corners = [(0, 0), (4, 0), (0, 4), (4, 4)]
    refs = frame([*corners, *corners, (float("nan"), 1.0)], v=[5.0] * 4 + [1.0] * 4 + [0.0]).coalesce(1)
    for order in ("id", "-id"):
        got = interpolate.linear_interpolate(frame([(1, 1), (2, 3)]), refs.orderBy(F.expr(order)), AXES, ["v"], 10.0)
        assert [round(r.v, 9) for r in got.orderBy("q_id").collect()] == [1.0, 1.0]


def test_knn_interpolate_asks_positions_once(frame, monkeypatch):
    asked, knn = [], interpolate.joins.knn
    monkeypatch.setattr(interpolate.joins, "knn", lambda q, *a, **k: asked.append(q.count()) or knn(q, *a, **k))
    refs = frame([(0, 0), (4, 0), (0, 4)], v=[1.0, 3.0, 5.0])
    got = interpolate.knn_interpolate(frame([(1, 0), (0, 4), (1, 0), (1, 0)]), refs, AXES, "v", 2).orderBy("q_id").collect()
    assert [(r.q_id, round(r.value, 9)) for r in got] == [(0, 1.5), (1, 5.0), (2, 1.5), (3, 1.5)]
    assert asked == [2]
