"""Radius, nearest and box joins against literal cases and brute force."""
# Points and expected results of the plain cases below must stay as they are.

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fieldloom.operators import filters, joins
from fieldloom.operators.frame import Extent

AXES = ["x", "y"]
LATTICE = [(i, j) for i in range(5) for j in range(10)]
SIX = [(0, 0), (0, 1), (1, 1), (2, 1), (1, 0.5), (0.5, 1)]


def ids(df, column="r_id"):
    return sorted(r[column] for r in df.collect())


def test_ball_cases(frame):
    lattice = frame(LATTICE)
    assert ids(joins.ball(frame([(0, 0)]), lattice, AXES, 1.1)) == [0, 1, 10]
    pairs = joins.ball(frame([(0, 0), (1, 1)]), lattice, AXES, 1.0).collect()
    assert {r["r_id"] for r in pairs if r["q_id"] == 0} == {0, 1, 10}
    assert {r["r_id"] for r in pairs if r["q_id"] == 1} == {1, 10, 11, 12, 21}


def test_ellipsoid(frame):
    scaled = [(x * 0.5, y * 0.8) for x, y in LATTICE]
    assert ids(joins.ball(frame([(0, 0)]), frame(scaled), AXES, 1.1)) == [0, 1, 10, 11, 20]


def test_ball_count(frame):
    six = frame(SIX)
    assert [r["n"] for r in joins.ball_count(six, six, AXES, 1.0).orderBy("q_id").collect()] == [2, 4, 5, 2, 3, 4]
    assert joins.ball_count(frame([(0.5, 0.5), (90, 90)]), six, AXES, 1.0).orderBy("q_id").collect()[0]["n"] == 5
    assert joins.ball_count(frame([(0.5, 0.5), (90, 90)]), six, AXES, 1.0).orderBy("q_id").collect()[1]["n"] == 0


def test_shell(frame):
    lattice, q = frame(LATTICE), frame([(3, 3)])
    assert ids(joins.shell(q, lattice, AXES, 1, 1.5, compat=True)) == [23, 32, 33, 34, 43]
    assert ids(joins.shell(q, lattice, AXES, 1, 1.5)) == [22, 24, 42, 44]


def test_knn_cases(frame):
    six = frame(SIX)
    one = joins.knn(frame([(0.5, 1)]), six, AXES, 2).orderBy("rank").collect()
    assert [r["r_id"] for r in one] == [5, 1]  # equal distances: the smaller id
    assert [round(r["sd"] ** 0.5, 2) for r in one] == [0, 0.5]
    many = joins.knn(frame([(0.5, 1), (1.5, 1), (0.5, 1)], k=[3, 1, 2]), six, AXES, "k").collect()
    assert sorted((r["q_id"], round(r["sd"] ** 0.5, 2)) for r in many) == [(0, 0), (0, 0.5), (0, 0.5), (1, 0.5), (2, 0), (2, 0.5)]


def test_nearest_other(frame):
    lattice = frame(LATTICE)
    asked = lattice.where("id in (0, 2, 5, 3)").select("id")
    assert all(r["sd"] == 1 for r in joins.nearest_other(lattice, AXES, ids=asked).collect())
    twins = joins.nearest_other(frame([(1, 1), (1, 1), (5, 5)]), AXES).orderBy("q_id").collect()
    assert [r["r_id"] for r in twins] == [1, 0, 0]


A = [(0, 0), (0, 0.1), (1, 1), (1, 0), (0.5, 0.5), (-1, -2)]
B = [(0.4, 0.4), (0.2, 0), (0.1, 1.2), (2, 1), (-1.1, -1.2)]


def test_matchers(frame):
    a, b = frame(A), frame(B)
    pairs = lambda df: sorted((r["a_id"], r["b_id"]) for r in df.collect())
    assert pairs(joins.match_pair(a, b, AXES, [0.3, 0.2])) == [(0, 1), (4, 0)]
    assert pairs(joins.match_sphere(a, b, AXES, [0.3, 0.2])) == [(0, 1), (1, 1), (4, 0)]
    assert pairs(joins.match_knn(a, b, AXES, [0.5, 0.5])) == [(0, 1), (4, 0)]
    assert pairs(joins.match_knn(a, b, AXES, [0.5, 0.5], 2)) == [(0, 1), (1, 1), (4, 0)]


def test_boxes_and_slices(frame):
    df = frame([(1, 2), (-1, 1), (0.5, 1)])
    assert ids(joins.box(df, AXES, Extent((0, 0.5), (1, 4))), "id") == [0, 2]
    assert joins.box_count(df, AXES, Extent((0, 0.5), (1, 4))) == 2
    assert ids(joins.slice_axis(df, "x", 0.5, 1.0), "id") == [0, 2]
    lattice = frame(LATTICE)
    assert ids(joins.cube(frame([(0, 0)]), lattice, AXES, 1.0)) == [0, 1, 10, 11]


def test_missing_and_empty(spark, frame):
    nan = spark.createDataFrame([(0, 1.0, None), (1, float("nan"), 1.0), (2, 1.0, 1.0)], "id bigint, x double, y double")
    assert ids(joins.ball(nan, nan, AXES, 5.0)) == [2]
    empty = nan.where("id < 0")
    assert joins.ball(empty, nan, AXES, 1.0).count() == 0
    assert joins.knn(nan, empty, AXES, 2).count() == 0
    assert joins.knn(empty, nan, AXES, 2).count() == 0
    assert joins.knn(nan, nan, AXES, 9).count() == 1
    with pytest.raises(ValueError):
        joins.ball(nan, nan, AXES, -1.0)


def test_hot_cell_is_salted(frame, monkeypatch):
    monkeypatch.setattr(joins, "HOT", 5)
    rng = np.random.default_rng(2)
    at = [tuple(p) for p in rng.normal(0, 0.2, (60, 2))] + [(9, 9)]
    df = frame(at)
    got = {(r["q_id"], r["r_id"]) for r in joins.ball(df, df, AXES, 0.3).collect()}
    assert got == {(i, j) for i, p in enumerate(at) for j, q in enumerate(at) if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= 0.09}


def test_crowded_position(frame):
    """A third of the rows at one place: the smallest ids answer ties, and a row is not its own neighbour."""
    rng = np.random.default_rng(4)
    at = [tuple(map(float, p)) for p in rng.integers(0, 30, (160, 2))]
    at[::2] = [(7.0, 7.0)] * 80
    df = frame(at)
    got = {}
    for r in joins.knn(df, df, AXES, 3, exclude_self=True).collect():
        got.setdefault(r["q_id"], []).append((r["rank"], r["r_id"]))
    for i, p in enumerate(at):
        want = sorted(((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2, j) for j, q in enumerate(at) if j != i)[:3]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-8, 8), st.integers(-8, 8)), min_size=1, max_size=25), st.sampled_from([0.5, 1.0, 2.0, 5.0]))
def test_ball_equals_theta(frame, points, r):
    """Whole-number positions: negative cells and points exactly at the radius."""
    df = frame(points)
    got = {(q["q_id"], q["r_id"]) for q in joins.ball(df, df, AXES, r).collect()}
    assert got == {(i, j) for i, p in enumerate(points) for j, q in enumerate(points) if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= r * r}
    alone = {q["id"] for q in filters.is_isolated(df, AXES, r).collect()}
    near = {q["id"] for q in filters.has_neighbour(df, AXES, r).collect()}
    assert alone | near == set(range(len(points))) and not alone & near


def test_radii_of_all_sizes(spark, monkeypatch):
    """Radii from 0 to 300, one of them far beyond the others, and crowded cells."""
    monkeypatch.setattr(joins, "HOT", 20)
    rng = np.random.default_rng(6)
    at = rng.random((200, 2)) * 40
    r = np.where(np.arange(200) % 5, rng.random(200) * 3, 0.0)
    r[7] = 300.0
    df = spark.createDataFrame([(i, float(x), float(y), float(v)) for i, ((x, y), v) in enumerate(zip(at, r))], "id bigint, x double, y double, r double")
    got = {(p.q_id, p.r_id) for p in joins.ball(df, df, ["x", "y"], "r").collect()}
    sd = ((at[:, None] - at[None]) ** 2).sum(axis=2)
    assert got == {(i, j) for i, j in zip(*np.nonzero(sd <= (r * r)[:, None]))}
    assert joins.ball(df.where("id < 0"), df, ["x", "y"], "r").count() == 0


def test_nearest_with_a_stray(spark):
    """One row far away changes neither results nor the first radius much."""
    at = np.concatenate([np.random.default_rng(1).random((300, 2)) * 10, [[1e6, 1e6]]])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "id bigint, x double, y double")
    rows = joins.points(df, ["x", "y"], "id", "r_")
    assert joins._usual_distance(rows, 2, 4, 301) < 3
    sd = ((at[:, None] - at[None]) ** 2).sum(axis=2)
    want = {(i, int(j)) for i in range(301) for j in np.lexsort((np.arange(301), sd[i]))[:3]}
    assert {(p.q_id, p.r_id) for p in joins.knn(df, df, ["x", "y"], 3).collect()} == want
