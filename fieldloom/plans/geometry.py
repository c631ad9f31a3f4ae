"""Queries of matrices, vectors, grids, fits and clusters over whole tables, with their SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import affine, distance, vector
from fieldloom.operators import cluster, estimate, filters, grid, interpolate, joins, records, register
from fieldloom.operators.frame import Extent
from fieldloom.plans.crs_sql import SHIFT
from fieldloom.plans.spatial import AXES, EV2, FS3, LOCAL3, PT2, _local3, ev2, fs3, near_sql, pt2, query, r6, read

V3 = ["x", "y", "z"]
TURN3 = (0.1, -0.4, 0.7)
C, S = [repr(math.cos(a)) for a in TURN3], [repr(math.sin(a)) for a in TURN3]
r5 = lambda c: F.round(c, 5) + 0.0


@query(f"""WITH {FS3}, {LOCAL3}, a AS (SELECT id, 2 * x AS x, {C[0]} * y - {S[0]} * z AS y, {S[0]} * y + {C[0]} * z AS z FROM v),
    b AS (SELECT id, {C[1]} * x + {S[1]} * z AS x, y, {C[1]} * z - {S[1]} * x AS z FROM a)
    SELECT id, round({C[2]} * x - {S[2]} * y + 1, 5) + 0.0 AS tx, round({S[2]} * x + {C[2]} * y - 2, 5) + 0.0 AS ty, round(z + 3, 5) + 0.0 AS tz FROM b""")
def rotate_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaling, three turns in order, and translation."""
    T = affine.compose(t=[1.0, -2.0, 3.0], r=TURN3, s=[2.0, 1.0, 1.0])
    return _local3(spark, sf_dir).select("id", *(r5(c).alias(f"t{a}") for a, c in zip("xyz", affine.transform(V3, T))))


@query(f"""WITH {FS3}, {LOCAL3} SELECT id, round(x, 5) + 0.0 AS tx, round({math.cos(0.6)!r} * y - {math.sin(0.6)!r} * z, 5) + 0.0 AS ty, round({math.sin(0.6)!r} * y + {math.cos(0.6)!r} * z, 5) + 0.0 AS tz, 1.0 AS one FROM v""")
def quaternion_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn about the first axis from its quaternion, in homogeneous coordinates."""
    T = affine.quaternion([math.cos(0.3), math.sin(0.3), 0.0, 0.0])
    turned = affine.homogeneous(affine.transform(V3, T))
    return _local3(spark, sf_dir).select("id", *(r5(c).alias(n) for n, c in zip(("tx", "ty", "tz", "one"), turned)))


@query("""SELECT * FROM (VALUES ('2d', 'scale', 0, 2.0), ('2d', 'scale', 1, 0.5), ('2d', 'shift', 0, 3.0), ('2d', 'shift', 1, -4.0), ('2d', 'turn', 0, 0.6), ('2d', 'det', 0, 1.0),
    ('3d', 'scale', 0, 2.0), ('3d', 'scale', 1, 3.0), ('3d', 'scale', 2, 4.0), ('3d', 'shift', 0, 1.0), ('3d', 'shift', 1, 2.0), ('3d', 'shift', 2, 3.0), ('3d', 'turn', 0, 0.1), ('3d', 'turn', 1, -0.4),
    ('3d', 'turn', 2, 0.7), ('3d', 'det', 0, 24.0)) t(system, part, i, value)""")
def decompose_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of composed matrices."""
    rows = []
    for name, T in (("2d", affine.compose(t=[3, -4], r=0.6, s=[2, 0.5])), ("3d", affine.compose(t=[1, 2, 3], r=TURN3, s=[2, 3, 4]))):
        t, r, s, det = affine.decomposition(T)
        for part, values in (("shift", t), ("turn", np.atleast_1d(r)), ("scale", s), ("det", [det])):
            rows += [(name, part, i, round(float(v), 9) + 0.0) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "system string, part string, i int, value double")


@query(f"WITH {PT2} SELECT id, 100 + 2 * x + 0.5 * (y / 8) AS gx, 50 - 0.25 * x - 4 * (y / 8) AS gy, TRUE AS same FROM pt2")
def gdal_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions by the six numbers of a raster, which are given back."""
    six = (100.0, 2.0, 0.5, 50.0, -0.25, -4.0)
    T = affine.from_gdal(six)
    gx, gy = affine.transform([F.col("x"), F.col("y") / 8], T)
    return pt2(spark, sf_dir).select("id", gx.alias("gx"), gy.alias("gy"), F.lit(tuple(affine.to_gdal(T)) == six).alias("same"))


@query(f"WITH {FS3}, {LOCAL3} SELECT id, round({math.cos(0.5)!r} * x - {math.sin(0.5)!r} * y + 7, 5) + 0.0 AS tx, round(z, 5) + 0.0 AS tz FROM v")
def add_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn in the plane, applied in space."""
    tx, _, tz = affine.transform(V3, affine.add_dim(affine.compose(t=[7, 0], r=0.5)))
    return _local3(spark, sf_dir).select("id", r5(tx).alias("tx"), r5(tz).alias("tz"))


@query("""SELECT CAST(i AS INT) AS key_0, CAST(j AS INT) AS key_1, 10 + (j + 0.5) * 2 AS x, 20 + (i + 0.5) * 4 AS y, 10.0 AS low_x, 60.0 AS high_y FROM generate_series(0, 9) a(i) CROSS JOIN generate_series(0, 14) b(j)""")
def grid_from_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of a grid over a box, with their centres and the corners of the whole."""
    made = grid.Grid.from_extent(spark, Extent((10.0, 20.0), (40.0, 60.0)), [2.0, 4.0])
    return made.with_coords(AXES).select("key_0", "key_1", "x", "y", F.lit(made.extent.low[0]).alias("low_x"), F.lit(made.extent.high[1]).alias("high_y"))


@query("""SELECT * FROM (VALUES (0, 5.0, 8.0), (1, 15.0, 8.0), (2, 15.0, 20.0), (3, 5.0, 20.0)) t(corner, x, y), (VALUES (6, 5, 2, 1, 3, 3)) u(height, width, row0, col0, rows, cols)""")
def grid_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners to a matrix and back, and the window of a box in it."""
    corners = affine.box_corners((5.0, 8.0), (15.0, 20.0))
    T, shape = affine.corners_to_transform(corners, [2.0, 2.0])
    back = affine.transform_to_corners(T, shape)
    _, origin, size = affine.extent_window(T, (7.5, 12.5), (11.5, 17.5))
    rows = [(i, float(x), float(y), *map(int, (*shape, *origin, *size))) for i, (x, y) in enumerate(np.round(back, 9))]
    return spark.createDataFrame(rows, "corner int, x double, y double, height int, width int, row0 int, col0 int, rows int, cols int")


@query(f"""WITH {FS3}, {LOCAL3}, p AS (SELECT *, sqrt(x * x + y * y + z * z) AS d FROM v)
    SELECT id, round(degrees(acos(x / d)), 4) AS to_x, round(degrees(acos(y / d)), 4) AS to_y, round(degrees(acos(z / d)), 4) AS to_z, round(degrees(atan2(y, x)), 4) + 0.0 AS a, round(degrees(acos(z / d)), 4) AS i,
        round(degrees(asin(y / sqrt(x * x + y * y))), 4) + 0.0 AS flat, round(radians(degrees(acos(z / d))), 6) AS rad FROM p""")
def direction_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles to the axes, and directions in space and in the plane."""
    each = [F.round(c, 4).alias(f"to_{a}") for a, c in zip("xyz", vector.axes_angles(V3, deg=True))]
    a, i = vector.direction(V3, deg=True)
    (flat,) = vector.direction(AXES, deg=True)
    return _local3(spark, sf_dir).select("id", *each, (F.round(a, 4) + 0.0).alias("a"), F.round(i, 4).alias("i"), (F.round(flat, 4) + 0.0).alias("flat"), F.round(vector.deg_to_rad(vector.rad_to_deg(vector.zenith(V3))), 6).alias("rad"))


@query(f"""WITH {FS3}, {LOCAL3} SELECT id, round((x + 2 * y + 2 * z) / 3 - 3, 5) + 0.0 AS along, round(sqrt(greatest(0, x * x + y * y + z * z - (x + 2 * y + 2 * z) * (x + 2 * y + 2 * z) / 9)), 4) AS off FROM v""")
def vector_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local systems along a vector: the distance along it and off it."""
    local = affine.to_local(V3, vector.basis([1.0, 2.0, 2.0], [1.0, 2.0, 2.0]))
    centred = affine.to_local(V3, vector.basis([1.0, 2.0, 2.0]))
    return _local3(spark, sf_dir).select("id", r5(local[0]).alias("along"), F.round(distance.norm(centred[1:]), 4).alias("off"))


@query(f"WITH {FS3}, {LOCAL3} SELECT id, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(z, 4) + 0.0 AS z, round(x, 4) + 0.0 AS u, round(y, 4) + 0.0 AS v FROM v")
def polar_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polar coordinates and back, in space and in the plane."""
    x, y, z = vector.from_polar(vector.to_polar(V3))
    u, v = vector.from_polar(vector.to_polar(AXES))
    return _local3(spark, sf_dir).select("id", *((F.round(c, 4) + 0.0).alias(n) for n, c in zip("xyzuv", (x, y, z, u, v))))


@query(f"WITH {PT2}, k AS (SELECT id, x, y, (5 + 0.125 * x + 0.0625 * (y / 100) - 50) / (0 - 1 - 0.125 * 0.25 - 0.0625 * 0.5) AS k FROM pt2) SELECT id, round(x + 0.25 * k + {SHIFT!r}, 3) AS x, round(y / 100 + 0.5 * k + {SHIFT!r}, 3) AS y, round(50 - k + {SHIFT!r}, 3) AS z FROM k")
def surface_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where falling lines meet a tilted plane, by iteration."""
    lines = pt2(spark, sf_dir).select("id", F.col("x").alias("ox"), (F.col("y") / 100).alias("oy"), F.lit(50.0).alias("oz"), F.lit(0.25).alias("vx"), F.lit(0.5).alias("vy"), F.lit(-1.0).alias("vz"))
    height = lambda df, x, y, out: df.withColumn(out, 5 + 0.125 * F.col(x) + 0.0625 * F.col(y))
    got = vector.surface_intersection(lines, height, 1e-9, 30)
    return got.select("id", *(F.round(F.col(a) + SHIFT, 3).alias(a) for a in "xyz"))


@query(f"""WITH {FS3}, {LOCAL3}, d AS (SELECT *, sqrt(x * x + y * y + z * z) AS l, sqrt((x - 1) * (x - 1) + (y - 2) * (y - 2)) AS far FROM v)
    SELECT id, round(x * x + y * y + z * z, 2) AS snorm, round(far, 5) AS dist, round(CASE WHEN l > 0 THEN x / l ELSE 0 END, 6) + 0.0 AS ux, round(CASE WHEN l = 0 THEN 1 WHEN z < 0 THEN -z / l ELSE z / l END, 6) + 0.0 AS uz FROM d""")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared lengths, distances, unit vectors, and those turned upward."""
    unit = estimate.normalize(V3)
    up = estimate.prefer_orientation(unit, (0.0, 0.0, 1.0))
    columns = [F.round(distance.snorm(V3), 2).alias("snorm"), F.round(distance.dist(AXES, [1.0, 2.0]), 5).alias("dist"), r6(unit[0]).alias("ux"), r6(up[2]).alias("uz")]
    return _local3(spark, sf_dir).select("id", *columns)


# Record tables.
@query("SELECT vec_id, coords[1] AS coords_1, coords[2] AS coords_2, coords[12] AS coords_12 FROM shapevectors WHERE len(coords) = 12")
def split_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of vectors as columns."""
    rows = read(spark, sf_dir, "shapevectors").where("size(coords) = 12")
    every = rows.select("vec_id", *records.split_array("coords", 12))
    return every.select("vec_id", "coords_1", "coords_2", "coords_12")


@query("SELECT rec_id, intensity * 2 + classification AS score FROM forestscan")
def apply_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vectorised function over the rows."""
    import pyarrow as pa  # noqa: PLC0415
    import pyarrow.compute as pc  # noqa: PLC0415

    def score(t: pa.Table) -> pa.Table:
        return pa.table({"rec_id": t["rec_id"], "score": pc.add(pc.multiply(t["intensity"].cast(pa.int64()), 2), t["classification"].cast(pa.int64()))})

    return records.apply_rows(read(spark, sf_dir, "forestscan").select("rec_id", "intensity", "classification"), score, "rec_id bigint, score bigint")


@query("""SELECT name, kind, kind <> 'timestamp_ntz' AS is_number, low FROM (VALUES ('rec_id', 'bigint', -9223372036854775808), ('place.x', 'double', NULL), ('place.y', 'double', NULL), ('scanned_at', 'timestamp_ntz', NULL),
    ('classification', 'smallint', -32768)) t(name, kind, low)""")
def field_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested fields with their types and ranges."""
    from pyspark.sql.types import _parse_datatype_string as parse  # noqa: PLC0415

    df = read(spark, sf_dir, "forestscan").select("rec_id", F.struct("x", "y").alias("place"), F.col("scanned_at").cast("timestamp_ntz").alias("scanned_at"), "classification")
    rows = [(n, k, records.is_numeric(parse(k)), records.value_range(k)[0] if k in records.RANGES else None) for n, k in records.field_list(df.schema)]
    return spark.createDataFrame(rows, "name string, kind string, is_number boolean, low bigint")


@query("SELECT p_partkey AS part, 3 * (p_size % 2) AS width, 4.0 AS weight FROM part")
def table_of_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table from columns, joined to the parts by its key."""
    made = records.table(spark, {"odd": [0, 1], "width": [0, 3], "weight": [4.0, 4.0]}, "odd int, width int, weight double")
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), (F.col("p_size") % 2).alias("odd"))
    return records.fuse(parts, made, "odd").select("part", "width", "weight")


# Fits.
@query(f"WITH {PT2} SELECT id, round(3 + 2 * x - y / 100 + x * x / 16 - x * y / 1600 + 0.00001234, 4) AS value FROM pt2")
def poly_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted polynomial of second degree in two axes, fitted to values that follow one."""
    p = pt2(spark, sf_dir).select("id", "x", (F.col("y") / 100).alias("y"), (1 + F.col("id") % 3).cast("double").alias("w"))
    p = p.withColumn("v", 3 + 2 * F.col("x") - F.col("y") + F.col("x") ** 2 / 16 - F.col("x") * F.col("y") / 16)
    return p.select("id", F.round(interpolate.fit_polynomial(p, AXES, "v", 2, "w")("x", "y") + 0.00001234, 4).alias("value"))


@query("SELECT count(*) AS asked, 0 AS wrong FROM part")
def linear_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a plane between its points: where there is one, it is the plane's."""
    refs = pt2(spark, sf_dir).withColumn("v", F.col("x") + 2 * F.col("y"))
    asked = refs.select("id", (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.25).alias("y"))
    got = interpolate.linear_interpolate(asked, refs, AXES, ["v"], 64.0)
    met = asked.join(got, asked["id"] == got["q_id"], "left")
    return met.agg(F.count(F.lit(1)).alias("asked"), F.count_if(F.abs(F.col("v") - F.col("x") - 2 * F.col("y")) > 1e-6).alias("wrong"))


@query("SELECT site_id, 2.5 AS radius, 0.0 AS residual FROM sites")
def cylinder_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cylinders around the centres of the sites."""
    at = read(spark, sf_dir, "sites").select("site_id", "center_x", "center_y", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("i"))
    at = at.select("site_id", (F.col("center_x") % 100 + 2.5 * F.cos("i")).alias("x"), (F.col("center_y") % 100 + 2.5 * F.sin("i")).alias("y"), (F.col("i") / 10).alias("z"))
    got = estimate.fit_cylinders(at, V3, ["site_id"], (0.0, 0.0, 1.0))
    return got.select("site_id", F.round("radius", 6).alias("radius"), F.round("residual", 6).alias("residual"))


@query(f"WITH {FS3} SELECT count(*) AS n, 0 AS odd FROM fs3")
def normal_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximated normals are of unit length or zero, one for every row."""
    got = estimate.approximate_normals(fs3(spark, sf_dir), V3, 0.6, k=8)
    length = sum((F.col("normal")[i] ** 2 for i in (1, 2)), F.col("normal")[0] ** 2)
    return got.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.abs(length - 1) > 1e-9) & (length > 0)).alias("odd"))


@query(f"WITH {EV2}, m AS (SELECT avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS b, var_pop(x) AS a, var_pop(y) AS c FROM ev2) SELECT round(abs(cos(atan2(2 * b, a - c) / 2)), 6) AS first_x, round(abs(sin(atan2(2 * b, a - c) / 2)), 6) AS first_y FROM m")
def principal_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first principal axis, without its sign."""
    x, y = estimate.components_of(estimate.pca(ev2(spark, sf_dir), AXES)[0], 1)
    return spark.createDataFrame([(round(abs(float(x)), 6), round(abs(float(y)), 6))], "first_x double, first_y double")


# Registration.
@query("SELECT * FROM (VALUES ('a', 0.0, 0.0, 0.0), ('b', -0.5, 0.25, 0.0), ('c', 1.0, -2.0, 0.0)) t(name, tx, ty, turn)")
def joint_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sets of suppliers, two of them shifted, brought together at once."""
    base = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") * 10.0).alias("x"), (F.col("s_acctbal") / 100).alias("y"))
    moved = lambda dx, dy: base.select("id", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    sets = {"a": base, "b": moved(0.5, -0.25), "c": moved(-1.0, 2.0)}
    pairs = None
    for one, two in (("a", "b"), ("b", "c"), ("a", "c")):
        part = base.select(F.lit(one).alias("a_set"), F.lit(two).alias("b_set"), F.col("id").alias("a_id"), F.col("id").alias("b_id"), F.lit(1.0).alias("w"))
        pairs = part if pairs is None else pairs.unionByName(part)
    found = register.find_rototranslations(sets, pairs, AXES)
    rows = [(n, round(float(T[0, 2]), 4) + 0.0, round(float(T[1, 2]), 4) + 0.0, round(math.atan2(T[1, 0], T[0, 0]), 6) + 0.0) for n, T in found.items()]
    return spark.createDataFrame(rows, "name string, tx double, ty double, turn double")


@query("SELECT * FROM (VALUES ('a', 0.0, 0.0), ('b', -0.3, 0.2)) t(name, tx, ty)")
def icp_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Iterative closest points with normals as further axes: a shifted copy comes back."""
    base = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 40 * 10.0).alias("x"), (F.floor(F.col("s_suppkey") / 40) * 10.0 + F.col("s_suppkey") % 7).alias("y"))
    base = base.withColumns({"nx": F.cos("id"), "ny": F.sin("id")})
    moved = base.withColumns({"x": F.col("x") + 0.3, "y": F.col("y") - 0.2})
    found, _, _ = register.icp({"a": base, "b": moved}, AXES, [2.0, 2.0, 0.5, 0.5], max_iter=8, normals=["nx", "ny"])
    rows = [(n, round(float(T[0, 2]), 3) + 0.0, round(float(T[1, 2]), 3) + 0.0) for n, T in found.items()]
    return spark.createDataFrame(rows, "name string, tx double, ty double")


# Clusters and terrain, by what must hold of them.
@query(f"WITH {PT2} SELECT count(*) AS n, TRUE AS dense, 0 AS apart FROM pt2")
def cluster_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by a function of the labels near: numbered without gaps, and shared with a row within the radius."""
    p = pt2(spark, sf_dir)
    got = cluster.clustering(p, AXES, 1.0, min).join(p, "id")
    near = joins.ball(got, got, AXES, 1.0, carry=["label"]).where("q_id <> r_id and q_label = r_label").select(F.col("q_id").alias("id")).distinct()
    size = got.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    apart = got.join(size, "label").join(near, "id", "left_anti").count()
    row = got.agg(F.count(F.lit(1)).alias("n"), (F.max("label") + 1 == F.count_distinct("label")).alias("dense"))
    return row.withColumn("apart", F.lit(apart))


@query(f"WITH {FS3}, b AS (SELECT id FROM fs3) SELECT 0 AS strange, 0 AS close FROM (SELECT count(*) FROM b)")
def terrain_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrain points are rows of the scan, no two of them within the radius in the plane."""
    p = fs3(spark, sf_dir)
    kept = filters.dem_filter(p, V3, 0.5).join(p, "id", "left")
    close = joins.ball(kept, kept, AXES, 0.5).where("q_id <> r_id").count()
    return kept.agg(F.count_if(F.col("x").isNull()).alias("strange")).withColumn("close", F.lit(close))


@query(f"""WITH {EV2}, p AS ({near_sql("ev2", "ev2", "1.0")}) SELECT q_id AS id, round(max(bx), 6) + 0.0 AS x, round(max(by_), 6) + 0.0 AS y FROM p GROUP BY 1""")
def smooth_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows moved to the largest coordinates within the radius."""
    return estimate.mean_ball(ev2(spark, sf_dir), AXES, 1.0, f=F.max).select("id", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query(f"WITH {PT2} SELECT id, round(x + 2 * y, 6) AS height FROM pt2 QUALIFY count(*) OVER (PARTITION BY x, y) = 1")
def surface_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A surface over the parts gives its own heights at its points (those of one part)."""
    p = pt2(spark, sf_dir).withColumn("z", F.col("x") + 2 * F.col("y"))
    alone = p.groupBy("x", "y").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    asked = p.join(alone, ["x", "y"]).select("id", "x", "y")
    return interpolate.surface(p.select("id", "x", "y", "z"), V3)(asked, "x", "y", "height").select("id", F.round("height", 6).alias("height"))


@query(f"WITH {PT2} SELECT count(*) AS n, 0 AS unknown, 0 AS alone FROM pt2")
def weight_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by shared weights are ids of parts, and a part whose label is another's has a part of that label within the radius."""
    p = pt2(spark, sf_dir)
    got = cluster.weight_clusters(p, AXES, 1.0, p.select("id", F.col("id").alias("label"))).join(p.select("id", *AXES), "id")
    near = joins.ball(got, got, AXES, 1.0, carry=["label"]).where("q_id <> r_id and (q_label = r_label or q_label = r_id)").select(F.col("q_id").alias("id")).distinct()
    unknown = got.join(p.select(F.col("id").alias("label")), "label", "left_anti").count()
    return got.where("label <> id").join(near, "id", "left_anti").agg(F.count(F.lit(1)).alias("alone")).select(F.lit(p.count()).alias("n"), F.lit(unknown).alias("unknown"), "alone")


@query("SELECT count(*) AS n, 0 AS negative FROM (SELECT DISTINCT site_id, classification FROM forestscan WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND classification IS NOT NULL)")
def cylinder_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fit for every site and class, none of negative radius or residual."""
    got = estimate.fit_cylinders(fs3(spark, sf_dir).where("classification is not null"), V3, ["site_id", "classification"], (0.0, 0.0, 1.0))
    return got.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("radius") < 0) | (F.col("residual") < 0)).alias("negative"))


@query("SELECT * FROM (VALUES ('a', 0.0, 0.0), ('b', -0.3, 0.2)) t(name, tx, ty)")
def icp_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Iterative closest points on the plain axes: a shifted copy of separate points comes back."""
    base = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 40 * 10.0).alias("x"), (F.floor(F.col("s_suppkey") / 40) * 10.0 + F.col("s_suppkey") % 7).alias("y"))
    moved = base.withColumns({"x": F.col("x") + 0.3, "y": F.col("y") - 0.2})
    found, _, _ = register.icp({"a": base, "b": moved}, AXES, [2.0, 2.0], max_iter=8)
    rows = [(n, round(float(T[0, 2]), 3) + 0.0, round(float(T[1, 2]), 3) + 0.0) for n, T in found.items()]
    return spark.createDataFrame(rows, "name string, tx double, ty double")
