"""Scalar functions, matrices, projections and grids against literal values."""
# Points and expected results of the plain cases below must stay as they are.

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import affine, distance, projection, vector
from fieldloom.operators import grid, records
from fieldloom.operators.frame import Extent, PointFrame

AXES = ["x", "y"]


def column(df, expr):
    return [r["v"] for r in df.select("id", expr.alias("v")).orderBy("id").collect()]


def test_distances(frame):
    df = frame([(3, 4), (0, 0)])
    assert column(df, distance.norm(AXES)) == [5, 0]
    assert column(df, distance.sdist(AXES, [3, 0])) == [16, 9]
    assert column(df, distance.idw(F.lit(1.0))) == [0.25, 0.25]
    assert distance.rmse(df, AXES, [0, 0]).first()["rmse"] == pytest.approx(math.sqrt(12.5))
    with pytest.raises(ValueError):
        distance.dist(AXES, [1])


def test_azimuth(frame):
    df = frame([(0, 0), (0, 1), (1, 1), (1, 0), (2, -2), (0, -1), (-1, 1)])
    got = column(df, vector.azimuth(AXES, deg=True))
    assert got[0] is None and np.allclose(got[1:], [0, 45, 90, 135, 180, 315])


def test_angles_and_polar(frame):
    df = frame([(1, 0, 0), (0, 0, 0), (1, 1, 1)])
    axes = ["x", "y", "z"]
    got = column(df, vector.angle(axes, [0, 1, 0], deg=True))
    assert got[0] == pytest.approx(90) and got[1] == math.inf
    assert column(df, vector.zenith(axes, deg=True))[0] == pytest.approx(90)
    back = df.select("id", *(c.alias(f"p{i}") for i, c in enumerate(vector.to_polar(axes))))
    again = back.select("id", *(c.alias(a) for a, c in zip("xyz", vector.from_polar(["p0", "p1", "p2"])))).orderBy("id").collect()
    assert np.allclose([[r.x, r.y, r.z] for r in again], [[1, 0, 0], [0, 0, 0], [1, 1, 1]])


def test_line_and_plane(frame):
    df = frame([(1, -1), (2, 1), (3, 3), (1.6, 1.2), (2.8, -0.4)])
    line = vector.Line((1, -1), (1, 2))
    got = column(df, line.distance(AXES))
    assert np.allclose(got[:3], 0)
    assert line.length == pytest.approx(math.sqrt(5)) and line.target == (2, 1)
    assert np.allclose(affine.apply(line.t, [(2, 1)])[0], [math.sqrt(5), 0])
    plane = vector.Plane((0, 0, 2), ((1, 0, 0), (0, 1, 0)))
    hit = frame([(0, 0, 5)]).select(*(c.alias(f"v{i}") for i, c in enumerate(vector.plane_intersection(["x", "y", "z"], [1, 0, -1], plane)))).first()
    assert (hit.v0, hit.v1, hit.v2) == (3, 0, 2)
    flat = frame([(0, 0, 5)]).select(vector.plane_intersection(["x", "y", "z"], [1, 0, 0], plane)[0].alias("v")).first()
    assert flat["v"] is None


def test_surface_intersection(spark):
    lines = spark.createDataFrame([(0, 0.0, 0.0, 10.0, 1.0, 0.0, -1.0), (1, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0)], "id bigint, ox double, oy double, oz double, vx double, vy double, vz double")
    got = vector.surface_intersection(lines, lambda df, x, y, out: df.withColumn(out, F.col(x) * 0.5)).orderBy("id").collect()
    assert got[0].z == pytest.approx(10 / 3, abs=0.01) and got[1].z is None


def test_matrices():
    assert np.allclose(affine.rotation([np.pi / 2, 0, np.pi / 4])[:3, :3], [[0.7071, 0, 0.7071], [0.7071, 0, -0.7071], [0, 1, 0]], atol=1e-4)
    t, r, s, det = affine.decomposition(affine.compose(t=[2, 3], r=0.2, s=[0.5, 2]))
    assert np.allclose(t, [2, 3]) and r == pytest.approx(0.2) and np.allclose(s, [0.5, 2]) and det == pytest.approx(1)
    assert np.allclose(affine.quaternion([math.sqrt(0.5), math.sqrt(0.5), 0, 0])[:3, :3], [[1, 0, 0], [0, 0, -1], [0, 1, 0]])
    assert affine.to_gdal(affine.from_gdal((1, 2, 3, 4, 5, 6))) == (1, 2, 3, 4, 5, 6)
    corners = affine.apply(affine.compose(t=[3, 5], s=[10, 20], r=np.pi / 2), affine.box_corners([0, 0], [1, 1]))
    M, shape = affine.corners_to_transform(corners)
    assert np.allclose(M, [[0, -1, 3], [1, 0, 5], [0, 0, 1]]) and shape == (20, 10)
    M, shape = affine.corners_to_transform(corners, [0.5, 2])
    assert np.allclose(M, [[0, -2, 3], [0.5, 0, 5], [0, 0, 1]]) and shape == (10, 20)
    T = affine.compose(t=[10, 20], s=[0.5, 2])
    assert np.allclose(affine.transform_to_corners(T, (100, 200)), [[10, 20], [110, 20], [110, 220], [10, 220]])
    M, key, shape = affine.extent_window(affine.compose(t=[100, 200], s=[2, -2]), [150, 250], [200, 300])
    assert np.allclose(M, [[2, 0, 150], [0, -2, 300], [0, 0, 1]]) and key == (-50, 25) and shape == (26, 26)
    with pytest.raises(ValueError):
        affine.compose()
    assert affine.add_dim(np.eye(3)).shape == (4, 4)
    assert np.allclose(affine.reflection(np.eye(3), 0)[0], [-1, 0, 0])


def test_transform_there_and_back(frame):
    T = affine.compose(t=[10, 5], r=0.7, s=[2, 0.5])
    df = frame([(1, 2), (-3, 4)])
    there = df.select("id", *(c.alias(a) for a, c in zip("xy", affine.to_local(AXES, T))))
    back = there.select("id", *(c.alias(a) for a, c in zip("xy", affine.to_global(AXES, T)))).orderBy("id").collect()
    assert np.allclose([(r.x, r.y) for r in back], [(1, 2), (-3, 4)])


def test_projection(spark):
    df = spark.createDataFrame([(0, 9.0, 0.0), (1, 9.0, 48.0), (2, 11.5, 52.25)], "id bigint, x double, y double")
    e, n = projection.reproject(F.col("x"), F.col("y"), "EPSG:4326", "EPSG:25832")
    got = df.select("id", e.alias("e"), n.alias("n")).orderBy("id").collect()
    assert (got[0].e, got[0].n) == (pytest.approx(500000), pytest.approx(0))
    arrays = projection.east_north_arrays(np.array([9.0, 11.5]), np.array([48.0, 52.25]), np.array(["geo"] * 2, object), np.full(2, 9.0), np.full(2, 0.9996), np.full(2, 5e5), np.zeros(2))
    assert np.allclose([(r.e, r.n) for r in got[1:]], np.column_stack(arrays), atol=1e-6)
    for system in ("EPSG:32633", "EPSG:3857", "EPSG:4326"):
        a, b = projection.reproject(F.lit(420000.0), F.lit(5500000.0), "EPSG:25832", system)
        there = spark.range(1).select(a.alias("a"), b.alias("b"))
        c, d = projection.reproject(F.col("a"), F.col("b"), system, "EPSG:25832")
        back = there.select(c.alias("c"), d.alias("d")).first()
        assert (back.c, back.d) == (pytest.approx(420000, abs=1e-3), pytest.approx(5500000, abs=1e-3))
    # Along the equator the scale at the central meridian is 0.9996: one degree of longitude.
    one = projection.east_north_arrays(np.array([9.001]), np.array([0.0]), np.array(["geo"], object), np.array([9.0]), np.array([0.9996]), np.array([5e5]), np.array([0.0]))
    assert one[0][0] - 500000 == pytest.approx(0.001 * math.pi / 180 * 6378137 * 0.9996, abs=1e-4)


@pytest.mark.parametrize(("text", "kind", "unit"), [("EPSG 25832", "tm", "m"), ("+proj=longlat +datum=WGS84", "geo", "deg"), ("+proj=utm +zone=32 +units=us-ft", "tm", "us-ft"), ("urn:ogc:def:crs:EPSG::3857", "merc", "m"), ("+proj=tmerc +lon_0=9 +k=0.9996 +x_0=500000 +to_meter=0.3048", "tm", "ft")])
def test_parse_proj(text, kind, unit):
    said = projection.parse_proj(text)
    assert (said["kind"], said["h"]) == (kind, unit)


@pytest.mark.parametrize("code", [4326, 3857, 25832, 32633])
def test_wkt(code):
    said, back = projection.parse_proj(f"EPSG:{code}"), projection.parse_proj(projection.wkt(code))
    assert back["kind"] == said["kind"] and back["h"] == said["h"]
    if said["kind"] == "tm":
        assert (back["lon0"], back["k0"], back["x0"]) == (said["lon0"], said["k0"], said["x0"])
    assert projection.parse_proj(projection.epsg(code))["kind"] == said["kind"]


def test_parse_unknown():
    assert projection.parse_proj(None) is None and projection.parse_proj("") is None and projection.parse_proj("?") is None
    assert projection.parse_remark(None) is None and projection.parse_remark("Flown at 900 ft above ground, point spacing 8 cm.") is None


def test_grid(spark, frame):
    T = affine.compose(t=[10, 20], s=[0.5, 0.4])
    g = grid.Grid.empty(spark, T, (4, 3))
    rows = g.with_coords(AXES).orderBy("key_0", "key_1").collect()
    assert len(rows) == 12 and (rows[0].x, rows[0].y) == (10.25, pytest.approx(20.2)) and (rows[-1].x, rows[-1].y) == (11.25, pytest.approx(21.4))
    assert grid.Grid.from_extent(spark, Extent((1, 1), (3, 4)), [0.5, 1]).shape == (3, 4)
    df = frame([(0, 0), (1, 1), (2, 1), (3, 0), (4, 1), (0, 4), (3, 7)])
    got = grid.voxelize(df, AXES, affine.compose(s=[2.5, 3]), [F.count(F.lit(1)).alias("n")], (3, 2), {"n": 0})
    assert {(r.key_0, r.key_1): r.n for r in got.collect()} == {(0, 0): 3, (0, 1): 2, (1, 0): 1, (1, 1): 0, (2, 0): 0, (2, 1): 1}
    near = grid.voxelize(frame([(-2, 0.3)]), AXES, affine.compose(s=[2.5, 3]), [F.count(F.lit(1)).alias("n")])
    assert near.first()["key_1"] == 0
    out = grid.voxelize(frame([(4.5, 0.5), (0.5, -1.5), (1.5, 0.5)]), AXES, np.eye(3), [F.count(F.lit(1)).alias("n")], (3, 4), {"n": 0})
    assert out.agg(F.sum("n")).first()[0] == 1
    custom = grid.voxelize_with(df, AXES, affine.compose(s=[2.5, 3]), lambda p: {"top": float(p.y.max())}, "top double")
    assert {(r.key_0, r.key_1): r.top for r in custom.collect()}[(2, 1)] == 7
    assert grid.collect_cells(df, AXES, affine.compose(s=[2.5, 3]), ["id"]).count() == 4


def test_frames_and_records(spark, frame):
    df = frame([(1, 2), (3, 4)], a=[1, 2])
    with pytest.warns(UserWarning):
        PointFrame(df, ("x", "y"))
    points = PointFrame(df, ("x", "y"), crs="EPSG:25832")
    assert points.extent() == Extent((1, 2), (3, 4)) and points.count() == 2 and points.dim == 2
    assert points.select_ids(spark.createDataFrame([(1,), (1,)], "id bigint")).count() == 2
    assert points.merge(points).count() == 4
    moved = points.transform(affine.translation([1, 1]))
    assert moved.extent() == Extent((2, 3), (4, 5)) and np.allclose(moved.t, affine.translation([1, 1]))
    with pytest.raises(ValueError):
        points.add_fields(a=F.lit(1))
    with pytest.raises(TypeError):
        PointFrame(spark.createDataFrame([("a", 1.0, 1)], "x string, y double, id bigint"), ("x", "y"), crs="EPSG:25832")
    with pytest.raises(ValueError):
        records.merge(df, df.drop("a"))
    nested = spark.sql("select 1 id, named_struct('p', 2, 'q', named_struct('r', 3)) s, array(4.0D, 5.0D) v")
    assert records.unnest(nested, True, {"v": 2}).columns == ["id", "s.p", "s.q.r", "v.1", "v.2"]
    assert records.field_list(nested.schema)[1] == ("s.p", "int")
    assert sorted(r["key_1"] for r in records.keys_of(spark, (1, 3)).collect()) == [0, 1, 2]
    assert records.smallest_type(spark.range(300), "id") == "smallint"
    assert records.activate(df, "intensity").columns[-1] == "intensity"
    doubled = records.apply_rows(df.select("id"), lambda t: t.set_column(0, "id", [[2 * v for v in t["id"].to_pylist()]]), "id bigint")
    assert sorted(r["id"] for r in doubled.collect()) == [0, 2]
    assert records.table(spark, {"id": [1, 2], "v": np.ones((2, 3))}).schema["v"].dataType.simpleString() == "array<double>"
