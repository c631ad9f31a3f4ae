"""Queries of the point, grid and geometry operators over whole tables, with their SQL.

Point views: events as (hours, value), parts as (size, price), orders as (days,
price), lineitem in three axes, and the forest scan. Both engines round results
to six decimals; scales are powers of two where keys are cut.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import affine, distance, projection, vector
from fieldloom.operators import cluster, estimate, filters, grid, highdim, interpolate, joins, records, register
from fieldloom.operators.frame import Extent
from fieldloom.session import shared_folder
from fieldloom.streaming.voxels import voxel_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name."""

    def keep(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6) + 0.0


# Point views.
def ev2(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 3.6e9
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), hours.alias("x"), F.col("value").alias("y"), "event_type", "ts")


def pt2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), "p_brand")


def od2(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1992-01-01 00:00:00', o_orderdate)") / 8.64e10
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), days.alias("x"), (F.col("o_totalprice") / 1000).alias("y"), "o_orderpriority")


def li3(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1992-01-01 00:00:00', l_shipdate)") / 8.64e10
    return read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), days.alias("z"), "l_returnflag")


def fs3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "forestscan").where("x is not null and y is not null and z is not null").select(F.col("rec_id").alias("id"), "x", "y", "z", "classification", "site_id")


EV2 = "ev2 AS (SELECT event_id AS id, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS x, value AS y, event_type FROM events)"
PT2 = "pt2 AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, p_brand FROM part)"
OD2 = "od2 AS (SELECT o_orderkey AS id, (epoch_us(o_orderdate) - 694224000000000) / 8.64e10 AS x, o_totalprice / 1000 AS y, o_orderpriority FROM orders)"
LI3 = "li3 AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y, (epoch_us(l_shipdate) - 694224000000000) / 8.64e10 AS z, l_returnflag FROM lineitem)"
FS3 = "fs3 AS (SELECT rec_id AS id, x, y, z, classification, site_id FROM forestscan WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL)"
AXES = ["x", "y"]


def near_sql(a: str, b: str, r: str, cond: str = "TRUE") -> str:
    """Theta join of two point tables within r, with the first axis as a prefilter."""
    return f"""SELECT a.id AS q_id, b.id AS r_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS sd, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_
        FROM {a} a JOIN {b} b ON b.x BETWEEN a.x - {r} AND a.x + {r} AND b.y BETWEEN a.y - {r} AND a.y + {r}
        WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {r} * {r} AND {cond}"""


# Grids.
T2 = affine.compose(t=[0.0, 0.0], s=[32.0, 64.0])


@query(f"""WITH {EV2} SELECT CAST(trunc(y / 64) AS INT) AS key_0, CAST(trunc(x / 32) AS INT) AS key_1, count(*) AS n, round(min(y), 6) + 0.0 AS min_y,
    round(avg(y), 6) + 0.0 AS avg_y, round(max(y), 6) + 0.0 AS max_y FROM ev2 GROUP BY 1, 2""")
def voxel_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = [F.count(F.lit(1)).alias("n"), r6(F.min("y")).alias("min_y"), r6(F.avg("y")).alias("avg_y"), r6(F.max("y")).alias("max_y")]
    return grid.voxelize(ev2(spark, sf_dir), AXES, T2, values)


@query(f"""WITH {EV2}, c AS (SELECT CAST(trunc(y / 64) AS INT) AS key_0, CAST(trunc(x / 32) AS INT) AS key_1, count(*) AS n, avg(y) AS m FROM ev2 GROUP BY 1, 2)
    SELECT CAST(i AS INT) AS key_0, CAST(j AS INT) AS key_1, coalesce(n, 0) AS n, round(m, 6) + 0.0 AS avg_y
    FROM generate_series(0, 8) a(i) CROSS JOIN generate_series(0, 22) b(j) LEFT JOIN c ON c.key_0 = i AND c.key_1 = j""")
def voxel_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.voxelize(ev2(spark, sf_dir), AXES, T2, [F.count(F.lit(1)).alias("n"), r6(F.avg("y")).alias("avg_y")], (9, 23), {"n": 0})


@query(f"""WITH {LI3} SELECT CAST(trunc(z / 128) AS INT) AS key_0, CAST(trunc(y / 16) AS INT) AS key_1, CAST(trunc(x / 8) AS INT) AS key_2, count(*) AS n,
    round(avg(y), 6) + 0.0 AS avg_y FROM li3 GROUP BY 1, 2, 3""")
def voxel_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    T = affine.compose(t=[0.0, 0.0, 0.0], s=[8.0, 16.0, 128.0])
    return grid.voxelize(li3(spark, sf_dir), ["x", "y", "z"], T, [F.count(F.lit(1)).alias("n"), r6(F.avg("y")).alias("avg_y")])


@query(f"""WITH {OD2} SELECT id, (trunc(x / 32) + 0.5) * 32 AS sx, (trunc(y / 64) + 0.5) * 64 AS sy FROM od2""")
def grid_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    sx, sy = grid.coords_to_coords(T2, AXES)
    return od2(spark, sf_dir).select("id", sx.alias("sx"), sy.alias("sy"))


@query(f"""WITH {OD2}, k AS (SELECT id, CAST(trunc(y / 64) AS INT) AS key_0, CAST(trunc(x / 32) AS INT) AS key_1 FROM od2),
    i AS (SELECT *, CAST(key_0 AS BIGINT) * 128 + key_1 AS number FROM k)
    SELECT id, key_0, key_1, number, CAST(number // 128 AS INT) AS back_0, CAST(number % 128 AS INT) AS back_1 FROM i""")
def grid_key_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = od2(spark, sf_dir).select("id", *grid.coords_to_keys(T2, AXES))
    numbered = keyed.withColumn("number", grid.keys_to_index((64, 128)))
    b0, b1 = grid.index_to_keys(F.col("number"), (64, 128))
    return numbered.select("id", "key_0", "key_1", "number", b0.alias("back_0"), b1.alias("back_1"))


@query(f"""WITH {EV2}, c AS (SELECT CAST(trunc(y / 64) AS INT) AS k0, CAST(trunc(x / 32) AS INT) AS k1, count(*) AS n FROM ev2 GROUP BY 1, 2)
    SELECT CAST(k0 - 1 AS INT) AS key_0, CAST(k1 - 3 AS INT) AS key_1, n FROM c WHERE k0 >= 1 AND k0 < 4 AND k1 >= 3 AND k1 < 12""")
def grid_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = grid.Grid(grid.voxelize(ev2(spark, sf_dir), AXES, T2, [F.count(F.lit(1)).alias("n")]), T2, (9, 23))
    return whole.window(Extent((100.0, 70.0), (390.0, 260.0))).df


# Extents and windows.
@query(f"""WITH {EV2} SELECT min(x) AS low_x, min(y) AS low_y, max(x) AS high_x, max(y) AS high_y FROM ev2""")
def extent_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = Extent.of(ev2(spark, sf_dir), AXES)
    return spark.createDataFrame([(*box.low, *box.high)], "low_x double, low_y double, high_x double, high_y double")


@query(f"""WITH {EV2} SELECT id FROM ev2 WHERE x BETWEEN 100 AND 300 AND y BETWEEN 20 AND 60""")
def extent_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.box(ev2(spark, sf_dir), AXES, Extent((100.0, 20.0), (300.0, 60.0))).select("id")


@query(f"""WITH {PT2}, b AS (SELECT id AS box_id, x - 2 AS lx, y - 5 AS ly, x + 2 AS hx, y + 5 AS hy FROM pt2)
    SELECT box_id, count(*) AS n FROM b JOIN pt2 p ON p.x BETWEEN lx AND hx AND p.y BETWEEN ly AND hy GROUP BY 1""")
def box_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = pt2(spark, sf_dir)
    extents = points.select(F.col("id").alias("box_id"), (F.col("x") - 2).alias("low_0"), (F.col("y") - 5).alias("low_1"), (F.col("x") + 2).alias("high_0"), (F.col("y") + 5).alias("high_1"))
    return joins.boxes(points, extents, AXES, 8.0).groupBy("box_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EV2} SELECT id FROM ev2 WHERE y BETWEEN 10 AND 12.5""")
def slice_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.slice_axis(ev2(spark, sf_dir), "y", 10.0, 12.5).select("id")


@query(f"""WITH {EV2} SELECT count(*) AS n FROM ev2 WHERE 2 * x + y <= 900 AND y >= 0 AND x >= 0""")
def hull_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = np.array([[0.0, 0.0], [450.0, 0.0], [0.0, 900.0]])
    return ev2(spark, sf_dir).where(filters.in_convex_hull(corners, AXES)).agg(F.count(F.lit(1)).alias("n"))


# Radius joins.
@query(f"""WITH {EV2}, p AS ({near_sql("ev2", "ev2", "1.0")}) SELECT q_id, r_id, round(sd, 6) + 0.0 AS sd FROM p""")
def ball_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ev2(spark, sf_dir)
    return joins.ball(e, e, AXES, 1.0).select("q_id", "r_id", r6(F.col("sd")).alias("sd"))


@query(f"""WITH {EV2}, {PT2}, s AS (SELECT id, x * 14 AS x, (y - 900) / 2 AS y FROM pt2), p AS ({near_sql("s", "ev2", "2.0")})
    SELECT s.id AS q_id, count(p.r_id) AS n FROM s LEFT JOIN p ON p.q_id = s.id GROUP BY 1""")
def ball_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = pt2(spark, sf_dir).select("id", (F.col("x") * 14).alias("x"), ((F.col("y") - 900) / 2).alias("y"))
    return joins.ball_count(asked, ev2(spark, sf_dir), AXES, 2.0)


@query(f"""WITH {EV2}, v AS (SELECT *, 0.25 + 0.25 * (id % 4) AS r FROM ev2)
    SELECT a.id AS q_id, b.id AS r_id FROM v a JOIN v b ON b.x BETWEEN a.x - a.r AND a.x + a.r
    WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= a.r * a.r""")
def ball_variable_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ev2(spark, sf_dir).withColumn("r", 0.25 + 0.25 * (F.col("id") % 4))
    return joins.ball(e, e, AXES, "r").select("q_id", "r_id")


@query(f"""WITH {EV2} SELECT a.id AS q_id, b.id AS r_id FROM ev2 a JOIN ev2 b ON b.x BETWEEN a.x - 2 AND a.x + 2
    WHERE (a.x / 2 - b.x / 2) * (a.x / 2 - b.x / 2) + (a.y / 0.5 - b.y / 0.5) * (a.y / 0.5 - b.y / 0.5) <= 1""")
def ball_ellipsoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ev2(spark, sf_dir)
    return joins.ellipsoid(e, e, AXES, [2.0, 0.5]).select("q_id", "r_id")


@query(f"""WITH {EV2} SELECT a.id AS q_id, b.id AS r_id FROM ev2 a JOIN ev2 b ON b.x BETWEEN a.x - 1 AND a.x + 1 WHERE greatest(abs(a.x - b.x), abs(a.y - b.y)) <= 0.75""")
def cube_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ev2(spark, sf_dir)
    return joins.cube(e, e, AXES, 0.75)


@query(f"""WITH {EV2}, p AS ({near_sql("ev2", "ev2", "1.5")}) SELECT q_id, r_id FROM p WHERE sd > 1""")
def shell_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ev2(spark, sf_dir)
    return joins.shell(e, e, AXES, 1.0, 1.5).select("q_id", "r_id")


@query(f"""WITH {FS3} SELECT a.id AS q_id, count(*) AS n FROM fs3 a JOIN fs3 b ON b.x BETWEEN a.x - 0.5 AND a.x + 0.5 AND b.y BETWEEN a.y - 0.5 AND a.y + 0.5
    WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.25 GROUP BY 1""")
def ball_count_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fs3(spark, sf_dir)
    return joins.ball_count(p, p, ["x", "y", "z"], 0.5)


# Nearest neighbours.
def knn_sql(a: str, b: str, k: str, cond: str = "TRUE") -> str:
    return f"""SELECT * FROM (SELECT a.id AS q_id, b.id AS r_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS sd,
        row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS rank FROM {a} a JOIN {b} b ON {cond}) WHERE rank <= {k}"""


@query(f"""WITH {PT2}, p AS ({knn_sql("pt2", "pt2", "5")}) SELECT q_id, r_id, round(sd, 6) + 0.0 AS sd, CAST(rank AS INT) AS rank FROM p""")
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pt2(spark, sf_dir)
    return joins.knn(p, p, AXES, 5).select("q_id", "r_id", r6(F.col("sd")).alias("sd"), "rank")


@query(f"""WITH {PT2}, v AS (SELECT *, 1 + id % 3 AS k FROM pt2), p AS ({knn_sql("v", "v", "3")}) SELECT q_id, r_id FROM p JOIN v ON v.id = p.q_id WHERE p.rank <= v.k""")
def knn_variable_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pt2(spark, sf_dir).withColumn("k", 1 + F.col("id") % 3)
    return joins.knn(p, p, AXES, "k").select("q_id", "r_id")


@query(f"""WITH {PT2}, p AS ({knn_sql("pt2", "pt2", "1", "a.id <> b.id")}) SELECT q_id, r_id, round(sd, 6) + 0.0 AS sd FROM p""")
def nn_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.nearest_other(pt2(spark, sf_dir), AXES).select("q_id", "r_id", r6(F.col("sd")).alias("sd"))


@query(f"""WITH {PT2}, s AS (SELECT * FROM pt2 WHERE x >= 40), p AS ({knn_sql("s", "pt2", "1", "a.id <> b.id")}) SELECT q_id, r_id FROM p""")
def closest_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pt2(spark, sf_dir)
    return joins.nearest_other(p, AXES, ids=p.where("x >= 40").select("id")).select("q_id", "r_id")


@query("""SELECT q_id, r_id FROM (SELECT a.vec_id AS q_id, b.vec_id AS r_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum([(u - v) * (u - v) for u, v in
    list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))]), b.vec_id) AS k
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE k <= 5""".replace("[(u - v) * (u - v) for u, v in\n    list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))]", "list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2]))"))
def emb_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set is every vector whose id is divisible by 100, against all vectors."""
    vectors = read(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("rep"), F.col("embedding").alias("coords"))
    asked = vectors.where("rep % 100 = 0").select(F.col("rep").alias("qid"), F.col("coords").alias("q"))
    return highdim.block_search(vectors, asked, 5, 64).select(F.col("qid").alias("q_id"), F.col("rep").alias("r_id"))


# Matchers: customers and suppliers by nation and balance.
MATCH = """a AS (SELECT c_custkey AS id, c_nationkey / 1.5 AS x, c_acctbal / 50 AS y FROM customer), b AS (SELECT s_suppkey AS id, s_nationkey / 1.5 AS x, s_acctbal / 50 AS y FROM supplier),
    p AS (SELECT a.id AS a_id, b.id AS b_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS sd FROM a JOIN b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("double").alias("x"), F.col("c_acctbal").alias("y"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("double").alias("x"), F.col("s_acctbal").alias("y"))
    return c, s


RADII = [1.5, 50.0]


@query(f"WITH {MATCH} SELECT a_id, b_id, round(sd, 6) + 0.0 AS sd FROM p WHERE sd <= 1")
def match_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.match_sphere(*_sides(spark, sf_dir), AXES, RADII).select("a_id", "b_id", r6(F.col("sd")).alias("sd"))


@query(f"WITH {MATCH} SELECT a_id, b_id FROM (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY sd, a_id) AS k FROM p WHERE sd < 1) WHERE k <= 2")
def match_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.match_knn(*_sides(spark, sf_dir), AXES, RADII, 2).select("a_id", "b_id")


@query(f"""WITH {MATCH} SELECT a_id, b_id FROM (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY sd, a_id) AS k, row_number() OVER (PARTITION BY a_id ORDER BY sd, b_id) AS j
    FROM p WHERE sd < 1) WHERE k = 1 AND j = 1""")
def match_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.match_pair(*_sides(spark, sf_dir), AXES, RADII).select("a_id", "b_id")


# Filters.
@query(f"""WITH {EV2}, p AS ({near_sql("ev2", "ev2", "1.0", "a.id <> b.id")}) SELECT DISTINCT q_id AS id FROM p""")
def has_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.has_neighbour(ev2(spark, sf_dir), AXES, 1.0)


@query(f"""WITH {EV2}, p AS ({near_sql("ev2", "ev2", "1.0", "a.id <> b.id")}) SELECT id FROM ev2 WHERE id NOT IN (SELECT q_id FROM p)""")
def is_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.is_isolated(ev2(spark, sf_dir), AXES, 1.0)


@query(f"""WITH {EV2}, p AS ({near_sql("ev2", "ev2", "2.0", "b.y + b.id / 1e9 > a.y + a.id / 1e9")}) SELECT id FROM ev2 WHERE id NOT IN (SELECT q_id FROM p)""")
def extrema_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.extrema(ev2(spark, sf_dir).withColumn("a", F.col("y") + F.col("id") / 1e9), AXES, "a", 2.0)


@query(f"""WITH {EV2}, p AS ({near_sql("ev2", "ev2", "2.0", "b.y + b.id / 1e9 < a.y + a.id / 1e9")}) SELECT id FROM ev2 WHERE id NOT IN (SELECT q_id FROM p)""")
def extrema_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.extrema(ev2(spark, sf_dir).withColumn("a", F.col("y") + F.col("id") / 1e9), AXES, "a", 2.0, inverse=True)


@query(f"""WITH {EV2}, p AS ({near_sql("ev2", "ev2", "1.5")}), k AS (SELECT q_id, r_id, row_number() OVER (PARTITION BY q_id ORDER BY by_, r_id) AS n FROM p) SELECT DISTINCT r_id AS id FROM k WHERE n = 1""")
def min_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.min_filter(ev2(spark, sf_dir), AXES, "y", 1.5)


def _greedy_sql(rounds: int = 40) -> str:
    """The greedy walk in rounds, each a few plain CTEs; more rounds than the events of scale 0.1 need."""
    parts = [f"""WITH {EV2}, p AS MATERIALIZED ({near_sql("ev2", "ev2", "1.0", "a.id <> b.id")}),
    e0 AS MATERIALIZED (SELECT q_id AS src, r_id AS dst FROM p WHERE ay > by_ OR (ay = by_ AND q_id > r_id)), u0 AS MATERIALIZED (SELECT id FROM ev2)"""]
    for i in range(rounds):
        parts.append(f"""s{i} AS MATERIALIZED (SELECT id FROM u{i} WHERE id NOT IN (SELECT dst FROM e{i})),
    u{i + 1} AS MATERIALIZED (SELECT id FROM u{i} WHERE id NOT IN (SELECT id FROM s{i}) AND id NOT IN (SELECT dst FROM e{i} WHERE src IN (SELECT id FROM s{i}))),
    e{i + 1} AS MATERIALIZED (SELECT src, dst FROM e{i} WHERE src IN (SELECT id FROM u{i + 1}) AND dst IN (SELECT id FROM u{i + 1}))""")
    return ", ".join(parts) + ", kept AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT id FROM s{i}" for i in range(rounds)) + ")"


GREEDY = _greedy_sql()


@query(f"{GREEDY} SELECT id FROM kept")
def ball_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.greedy_ball(ev2(spark, sf_dir), AXES, 1.0)


@query(f"""{GREEDY}, k AS (SELECT q_id, r_id, row_number() OVER (PARTITION BY q_id ORDER BY by_ DESC, r_id DESC) AS n FROM (SELECT * FROM p UNION ALL SELECT id, id, 0, x, y, x, y FROM ev2)
    WHERE q_id IN (SELECT id FROM kept)) SELECT DISTINCT r_id AS id FROM k WHERE n = 1""")
def surface_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.surface(ev2(spark, sf_dir), AXES, 1.0)


@query()
def dem_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrain points of the forest scan."""
    return filters.dem_filter(fs3(spark, sf_dir), ["x", "y", "z"], 0.5)


# Clusters and classes.
def dbscan_sql(eps: str, least: int) -> str:
    return f"""WITH RECURSIVE {EV2}, p AS ({near_sql("ev2", "ev2", eps)}), core AS (SELECT q_id AS id FROM p GROUP BY 1 HAVING count(*) >= {least}),
    e AS (SELECT q_id AS a, r_id AS b FROM p WHERE q_id IN (SELECT id FROM core) AND r_id IN (SELECT id FROM core)),
    reach(id, l) AS (SELECT id, id FROM core UNION SELECT e.b, r.l FROM reach r JOIN e ON e.a = r.id WHERE r.l < e.b),
    lab AS (SELECT id, dense_rank() OVER (ORDER BY min(l)) - 1 AS label FROM reach GROUP BY id)
    SELECT ev2.id, coalesce(min(lab.label), -1) AS label, bool_or(core.id IS NOT NULL) AS core FROM ev2 LEFT JOIN p ON p.q_id = ev2.id LEFT JOIN lab ON lab.id = p.r_id
    LEFT JOIN core ON core.id = ev2.id GROUP BY ev2.id"""


@query(dbscan_sql("1.5", 3))
def dbscan_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.dbscan(ev2(spark, sf_dir), AXES, 3, 1.5)


@query(f"""WITH {PT2}, p AS ({knn_sql("pt2", "pt2", "3", "a.id <> b.id")}) SELECT round(quantile_cont(sqrt(sd), 0.8) * 3, 6) AS epsilon FROM p""")
def dbscan_auto_eps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(cluster.auto_epsilon(pt2(spark, sf_dir), AXES, 3), 6),)], "epsilon double")


@query()
def majority_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by majority, densest points first."""
    return cluster.majority_clusters(pt2(spark, sf_dir), AXES, 1.0)


@query()
def weight_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by shared weights, from one cluster per point."""
    p = pt2(spark, sf_dir)
    return cluster.weight_clusters(p, AXES, 1.0, p.select("id", F.col("id").alias("label")))


@query("SELECT classification AS label, count(*) AS n FROM georecords WHERE classification <> -1 GROUP BY 1 HAVING count(*) >= 100")
def class_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.class_sizes(read(spark, sf_dir, "georecords"), "classification", 100)


@query("SELECT p_size AS label, list_sort(list(p_partkey)) AS ids FROM part GROUP BY 1 HAVING count(*) BETWEEN 10 AND 45")
def class_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.class_dict(read(spark, sf_dir, "part"), "p_partkey", "p_size", 10, 45)


@query("SELECT p_size AS label, list_sort(list(p_partkey)) AS ids FROM part WHERE p_size <> -1 GROUP BY 1")
def class_dict_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without bounds of size: all labels at every scale."""
    return cluster.class_dict(read(spark, sf_dir, "part"), "p_partkey", "p_size")


@query("""SELECT i AS id, coalesce(p_size, -1) AS label FROM (SELECT unnest(generate_series(0, (SELECT max(p_partkey) FROM part))) AS i) g LEFT JOIN part ON p_partkey = i""")
def dict_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all ids up to the last of the table."""
    part = read(spark, sf_dir, "part")
    last = part.agg(F.max("p_partkey").alias("last")).first()["last"]
    return cluster.dict_classes(cluster.class_dict(part, "p_partkey", "p_size"), (-1 if last is None else last) + 1)


@query(f"WITH {EV2} SELECT id, CAST(y >= 1 AS INT) + CAST(y >= 10.5 AS INT) + CAST(y >= 40 AS INT) AS part FROM ev2")
def split_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev2(spark, sf_dir).select("id", cluster.split_by_breaks(F.col("y"), [1, 10.5, 40]).alias("part"))


@query("""WITH c AS (SELECT scan_id, classification, count(*) AS n FROM georecords WHERE classification IS NOT NULL GROUP BY 1, 2), m AS (SELECT *, max(n) OVER (PARTITION BY scan_id) AS best FROM c)
    SELECT scan_id, CASE WHEN count(*) = 1 THEN any_value(classification) ELSE -1 END AS classification FROM m WHERE n = best GROUP BY 1""")
def majority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.majority(read(spark, sf_dir, "georecords"), ["scan_id"], "classification")


@query("SELECT rec_id, dense_rank() OVER (ORDER BY site_id) - 1 AS label FROM forestscan WHERE site_id IS NOT NULL")
def rename_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.rename_labels(read(spark, sf_dir, "forestscan").where("site_id is not null").select("rec_id", F.col("site_id").alias("label")))


# Scalars.
@query(f"WITH {FS3} SELECT id, round(sqrt(x * x + y * y + z * z), 4) AS len, round((x - 4e5) * (x - 4e5) + (y - 5.5e6) * (y - 5.5e6), 0) AS sd, round(1 / pow(1 + abs(z), 2), 6) AS w FROM fs3")
def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fs3(spark, sf_dir).select("id", F.round(distance.norm(["x", "y", "z"]), 4).alias("len"), F.round(distance.sdist(AXES, [4e5, 5.5e6]), 0).alias("sd"), F.round(distance.idw(F.abs("z")), 6).alias("w"))


@query(f"WITH {EV2} SELECT round(sqrt(avg((x - 360) * (x - 360) + (y - 50) * (y - 50))), 6) AS rmse FROM ev2")
def dist_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distance.rmse(ev2(spark, sf_dir), AXES, [360.0, 50.0]).select(F.round("rmse", 6).alias("rmse"))


@query(f"WITH {EV2}, p AS (SELECT id, x - 360 AS x, y - 50 AS y FROM ev2) SELECT id, round(sqrt(x * x + y * y), 6) AS d, round(atan2(y, x), 6) + 0.0 AS a FROM p")
def polar_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, a = vector.to_polar([F.col("x") - 360, F.col("y") - 50])
    return ev2(spark, sf_dir).select("id", F.round(d, 6).alias("d"), r6(a).alias("a"))


LOCAL3 = "v AS (SELECT fs3.id, fs3.x - center_x AS x, fs3.y - center_y AS y, fs3.z - center_z AS z FROM fs3 JOIN sites USING (site_id))"


def _local3(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = fs3(spark, sf_dir).join(F.broadcast(read(spark, sf_dir, "sites").select("site_id", "center_x", "center_y", "center_z")), "site_id")
    return joined.select("id", *((F.col(a) - F.col(f"center_{a}")).alias(a) for a in "xyz"))


@query(f"""WITH {FS3}, {LOCAL3}, p AS (SELECT id, x, y, z, sqrt(x * x + y * y + z * z) AS d FROM v)
    SELECT id, round(d, 5) AS d, round(atan2(y, x), 6) + 0.0 AS a, round(acos(greatest(-1, least(1, z / nullif(d, 0)))), 6) AS i FROM p""")
def polar_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, a, i = vector.to_polar(["x", "y", "z"])
    return _local3(spark, sf_dir).select("id", F.round(d, 5).alias("d"), r6(a).alias("a"), F.round(i, 6).alias("i"))


@query(f"""WITH {FS3}, {LOCAL3}, p AS (SELECT *, sqrt(x * x + y * y + z * z) AS d FROM v)
    SELECT id, round(degrees(acos(greatest(-1, least(1, (x + 2 * y - z) / (d * sqrt(6)))))), 4) AS angle, round(degrees(acos(greatest(-1, least(1, z / d)))), 4) AS zenith,
    round(degrees(pi() - atan2(x, -y)), 4) + 0.0 AS azimuth, x * y = 0 AS flat FROM p""")
def vector_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ["x", "y", "z"]
    columns = [F.round(vector.angle(v, [1.0, 2.0, -1.0], deg=True), 4).alias("angle"), F.round(vector.zenith(v, deg=True), 4).alias("zenith"), (F.round(vector.azimuth(v, deg=True), 4) + 0.0).alias("azimuth")]
    return _local3(spark, sf_dir).select("id", *columns, vector.orthogonal(["x", 0.0], ["y", 0.0]).alias("flat"))


@query(f"""WITH {FS3}, {LOCAL3}, k AS (SELECT *, (x + 2 * y + 2 * z) / 9 AS k FROM v)
    SELECT id, round(k, 6) + 0.0 AS k, round(sqrt((x - k) * (x - k) + (y - 2 * k) * (y - 2 * k) + (z - 2 * k) * (z - 2 * k)), 5) AS off_line, round(abs(x + y - 5) / sqrt(2), 5) AS off_plane FROM k""")
def line_and_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = vector.Line((0.0, 0.0, 0.0), (1.0, 2.0, 2.0))
    plane = vector.Plane((5.0, 0.0, 0.0), ((0.0, 0.0, 1.0), (1.0, -1.0, 0.0)))
    v = ["x", "y", "z"]
    return _local3(spark, sf_dir).select("id", r6(line.k(v)).alias("k"), F.round(line.distance(v), 5).alias("off_line"), F.round(plane.distance(v), 5).alias("off_plane"))


@query(f"""WITH {FS3}, {LOCAL3} SELECT id, round(x + (100 - z) / 4 * 1, 5) + 0.0 AS x, round(y + (100 - z) / 4 * 2, 5) + 0.0 AS y, round(z + (100 - z), 5) AS z FROM v""")
def plane_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    plane = vector.Plane((0.0, 0.0, 100.0), ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0)))
    x, y, z = vector.plane_intersection(["x", "y", "z"], [1.0, 2.0, 4.0], plane)
    return _local3(spark, sf_dir).select("id", (F.round(x, 5) + 0.0).alias("x"), (F.round(y, 5) + 0.0).alias("y"), F.round(z, 5).alias("z"))


TURN = affine.compose(t=[10.0, -5.0], r=0.5, s=[2.0, 0.25])


@query(f"""WITH {EV2} SELECT id, round({math.cos(0.5)!r} * (2 * x) - {math.sin(0.5)!r} * (0.25 * y) + 10, 6) + 0.0 AS tx, round({math.sin(0.5)!r} * (2 * x) + {math.cos(0.5)!r} * (0.25 * y) - 5, 6) + 0.0 AS ty FROM ev2""")
def affine_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx, ty = affine.transform(AXES, TURN)
    return ev2(spark, sf_dir).select("id", r6(tx).alias("tx"), r6(ty).alias("ty"))


@query(f"WITH {EV2} SELECT id, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y FROM ev2")
def inverse_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = ev2(spark, sf_dir).select("id", *(c.alias(n) for c, n in zip(affine.transform(AXES, TURN), "xy")))
    x, y = affine.to_global(AXES, TURN)
    return moved.select("id", (F.round(x, 4) + 0.0).alias("x"), (F.round(y, 4) + 0.0).alias("y"))


def _tm_sql() -> str:
    """Degrees to zone 32 by the series, in stages."""
    e = repr(projection._ECC)
    east = " + ".join(f"{c!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(projection._FORWARD, 1))
    north = " + ".join(f"{c!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(projection._FORWARD, 1))
    k = repr(projection.UTM_SCALE * projection._RECT)
    return f"""WITH {EV2}, g AS (SELECT id, radians(x / 500) AS d, sin(radians(48 + y / 200)) AS s FROM ev2),
    t AS (SELECT id, d, sinh(atanh(s) - {e} * atanh({e} * s)) AS t FROM g), u AS (SELECT id, atan2(t, cos(d)) AS xi, asinh(sin(d) / sqrt(t * t + cos(d) * cos(d))) AS eta FROM t)
    SELECT id, round(500000 + {k} * (eta + {east}), 3) AS east, round({k} * (xi + {north}), 3) AS north FROM u"""


@query(_tm_sql())
def project_utm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events spread over degrees, in metres of the zone."""
    east, north = projection.reproject(9 + F.col("x") / 500, 48 + F.col("y") / 200, "EPSG:4326", "EPSG:25832")
    return ev2(spark, sf_dir).select("id", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@query("SELECT site_id, round(center_x, 3) AS x, round(center_y, 3) AS y FROM sites")
def project_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = read(spark, sf_dir, "sites")
    lon, lat = projection.reproject(F.col("center_x"), F.col("center_y"), "EPSG:25832", "EPSG:4326")
    there = sites.select("site_id", lon.alias("lon"), lat.alias("lat"))
    x, y = projection.reproject(F.col("lon"), F.col("lat"), "EPSG:4326", "EPSG:25832")
    return there.select("site_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


# Moments.
MOMENTS = """m AS (SELECT event_type, count(*) AS n, avg(x) AS mx, avg(y) AS my, sum(x * x) - count(*) * avg(x) * avg(x) AS a, sum(x * y) - count(*) * avg(x) * avg(y) AS b,
    sum(y * y) - count(*) * avg(y) * avg(y) AS c FROM ev2 GROUP BY 1), h AS (SELECT *, (a + c) / 2 AS s, sqrt((a - c) * (a - c) / 4 + b * b) AS r FROM m),
    l AS (SELECT *, sqrt(b * b + (s + r - a) * (s + r - a)) AS q FROM h),
    w AS (SELECT *, CASE WHEN abs(b) >= abs(s + r - a) THEN sign(b) ELSE sign(s + r - a) END AS g FROM l)"""


@query(f"WITH {EV2}, {MOMENTS} SELECT event_type, round(g * b / q, 6) + 0.0 AS v0, round(g * (s + r - a) / q, 6) + 0.0 AS v1 FROM w")
def eigen_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev2(spark, sf_dir)
    mean = rows.groupBy("event_type").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    centred = rows.join(mean, "event_type").select("event_type", (F.col("x") - F.col("mx")).alias("dx"), (F.col("y") - F.col("my")).alias("dy"))
    got = estimate.group_vectors(centred, ["event_type"], [F.col("dx"), F.col("dy")], -1)
    return got.select("event_type", r6(F.col("vector")[0]).alias("v0"), r6(F.col("vector")[1]).alias("v1"))


WHOLE = """m AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS a, covar_pop(x, y) * count(*) AS b, var_pop(y) * count(*) AS c FROM ev2),
    h AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS l1, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS l2 FROM m)"""


@query(f"WITH {EV2}, {WHOLE} SELECT round(l1 / n, 4) AS var_0, round(l2 / n, 4) AS var_1, round(l1 / (l1 + l2), 6) AS ratio_0, round(l2 / (l1 + l2), 6) AS ratio_1 FROM h")
def explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ev2(spark, sf_dir)
    got = estimate.explained_variance(e, AXES, estimate.pca(e, AXES)[0])
    return got.select(F.round("var_0", 4).alias("var_0"), F.round("var_1", 4).alias("var_1"), F.round("ratio_0", 6).alias("ratio_0"), F.round("ratio_1", 6).alias("ratio_1"))


@query(f"""WITH {EV2}, {WHOLE}, e AS (SELECT mx, my, b, l1 - a AS d, sqrt(b * b + (l1 - a) * (l1 - a)) AS q, CASE WHEN abs(b) >= abs(l1 - a) THEN sign(b) ELSE sign(l1 - a) END AS g FROM h)
    SELECT id, round(g * ((x - mx) * b + (y - my) * d) / q, 5) + 0.0 AS score FROM ev2 CROSS JOIN e""")
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ev2(spark, sf_dir)
    return e.select("id", (F.round(affine.to_local(AXES, estimate.pca(e, AXES)[0])[0], 5) + 0.0).alias("score"))


@query(f"""WITH {EV2}, m AS (SELECT event_type AS g, avg(x) AS mx, avg(y) AS my FROM ev2 GROUP BY 1), d AS (SELECT g, mx, my, x - mx AS u, y - my AS v FROM ev2 JOIN m ON g = event_type),
    s AS (SELECT g, mx, my, count(*) AS n, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum(u * (u * u + v * v)) AS ub, sum(v * (u * u + v * v)) AS vb, sum(u * u + v * v) AS bb FROM d GROUP BY 1, 2, 3),
    p AS (SELECT *, (ub * vv - vb * uv) / (uu * vv - uv * uv) / 2 AS cu, (uu * vb - uv * ub) / (uu * vv - uv * uv) / 2 AS cv FROM s)
    SELECT g AS event_type, n, round(mx + cu, 3) AS cx, round(my + cv, 3) AS cy, round(sqrt(cu * cu + cv * cv + bb / n), 3) AS radius FROM p""")
def sphere_fit_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = estimate.fit_spheres(ev2(spark, sf_dir), AXES, ["event_type"])
    return got.select("event_type", "n", F.round(F.col("center")[0], 3).alias("cx"), F.round(F.col("center")[1], 3).alias("cy"), F.round("radius", 3).alias("radius"))


@query(f"""WITH {EV2}, p AS ({near_sql("ev2", "ev2", "1.5")}), m AS (SELECT q_id AS id, count(*) AS n, sum((bx - ax) * (bx - ax)) - sum(bx - ax) * sum(bx - ax) / count(*) AS a,
    sum((bx - ax) * (by_ - ay)) - sum(bx - ax) * sum(by_ - ay) / count(*) AS b, sum((by_ - ay) * (by_ - ay)) - sum(by_ - ay) * sum(by_ - ay) / count(*) AS c FROM p GROUP BY 1),
    h AS (SELECT *, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS l FROM m)
    SELECT id, round(abs(l - a) / sqrt(b * b + (l - a) * (l - a)), 4) AS n1 FROM h WHERE n >= 3 AND b * b + (l - a) * (l - a) > 1e-6""")
def normals_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the second component of normals, of points with at least three neighbours that are not aligned with an axis."""
    e = ev2(spark, sf_dir)
    near = estimate._neighbourhoods(e, AXES, 1.5, None, "id")
    d0, d1 = F.col("d0"), F.col("d1")
    spread = near.groupBy("q_id").agg(F.count(F.lit(1)).alias("n"), (F.sum(d0 * d0) - F.sum(d0) * F.sum(d0) / F.count(F.lit(1))).alias("a"), (F.sum(d0 * d1) - F.sum(d0) * F.sum(d1) / F.count(F.lit(1))).alias("b"), (F.sum(d1 * d1) - F.sum(d1) * F.sum(d1) / F.count(F.lit(1))).alias("c"))
    low = (F.col("a") + F.col("c")) / 2 - F.sqrt((F.col("a") - F.col("c")) ** 2 / 4 + F.col("b") ** 2)
    kept = spread.where("n >= 3").where(F.col("b") ** 2 + (low - F.col("a")) ** 2 > 1e-6).select(F.col("q_id").alias("id"))
    return estimate.fit_normals(e, AXES, 1.5).join(kept, "id").select("id", F.round(F.abs(F.col("normal")[1]), 4).alias("n1"))


@query()
def cylinder_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cylinder for the returns of each site and class of the forest scan."""
    got = estimate.fit_cylinders(fs3(spark, sf_dir).where("classification is not null"), ["x", "y", "z"], ["site_id", "classification"], (0.0, 0.0, 1.0))
    return got.select("site_id", "classification", "radius", "residual")


@query()
def approximate_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate.approximate_normals(fs3(spark, sf_dir), ["x", "y", "z"], 0.6)


# Interpolation and smoothing.
@query(f"""WITH {PT2}, r AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, length(p_name) * 1.0 AS v FROM part), q AS (SELECT id, x + 0.5 AS x, y + 0.25 AS y FROM pt2),
    p AS ({knn_sql("q", "r", "4")}) SELECT q_id, round(sum(v / sqrt(sd)) / sum(1 / sqrt(sd)), 6) + 0.0 AS value FROM p JOIN r ON r.id = p.r_id GROUP BY 1""")
def knn_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), (F.length("p_name") * 1.0).alias("v"))
    asked = refs.select("id", (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.25).alias("y"))
    return interpolate.knn_interpolate(asked, refs, AXES, "v", 4).select("q_id", r6(F.col("value")).alias("value"))


@query(f"WITH {EV2}, c AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM ev2) SELECT id, round(i + s * x, 6) + 0.0 AS value FROM ev2 CROSS JOIN c")
def poly_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ev2(spark, sf_dir)
    return e.select("id", r6(interpolate.fit_polynomial(e, ["x"], "y", 1)("x")).alias("value"))


@query()
def linear_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights at the centres between parts, from triangles."""
    refs = pt2(spark, sf_dir).withColumn("v", F.col("x") + 2 * F.col("y"))
    asked = refs.select("id", (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.25).alias("y"))
    return interpolate.linear_interpolate(asked, refs, AXES, ["v"], 64.0)


@query(f"""WITH {EV2}, p AS ({near_sql("ev2", "ev2", "1.0")}) SELECT q_id AS id, round(avg(bx), 6) + 0.0 AS x, round(avg(by_), 6) + 0.0 AS y FROM p GROUP BY 1""")
def smooth_ball_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate.mean_ball(ev2(spark, sf_dir), AXES, 1.0).select("id", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query(f"""WITH {EV2}, p AS MATERIALIZED ({near_sql("ev2", "ev2", "1.0")}), s1 AS (SELECT q_id AS id, avg(bx) AS x, avg(by_) AS y FROM p GROUP BY 1),
    s2 AS (SELECT q_id AS id, avg(s1.x) AS x, avg(s1.y) AS y FROM p JOIN s1 ON s1.id = p.r_id GROUP BY 1), s3 AS (SELECT q_id AS id, avg(s2.x) AS x, avg(s2.y) AS y FROM p JOIN s2 ON s2.id = p.r_id GROUP BY 1)
    SELECT id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM s3""")
def smooth_ball_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate.mean_ball(ev2(spark, sf_dir), AXES, 1.0, 3).select("id", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query(f"""WITH {PT2}, p AS ({knn_sql("pt2", "pt2", "4")}) SELECT q_id AS id, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y FROM p JOIN pt2 ON pt2.id = p.r_id GROUP BY 1""")
def smooth_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate.mean_knn(pt2(spark, sf_dir), AXES, 4).select("id", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


# Registration.
def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx, ty = affine.transform(AXES, affine.compose(t=[3.0, -2.0], r=0.3, s=[1.5, 0.5]))
    return pt2(spark, sf_dir).select(tx.alias("ax"), ty.alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))


@query(f"SELECT round({1.5 * math.cos(0.3)!r}, 6) AS t00, round({-0.5 * math.sin(0.3)!r}, 6) AS t01, 3.0 AS t02, round({1.5 * math.sin(0.3)!r}, 6) AS t10, round({0.5 * math.cos(0.3)!r}, 6) AS t11, -2.0 AS t12")
def affine_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    T = register.find_transformation(_pairs(spark, sf_dir), ["ax", "ay"], ["bx", "by"])
    return spark.createDataFrame([tuple(round(float(v), 6) for v in T[:2].ravel())], ", ".join(f"t{i}{j} double" for i in (0, 1) for j in range(3)))


@query(f"""WITH {PT2}, q AS (SELECT x AS bx, y AS by_, {math.cos(0.3)!r} * 1.5 * x - {math.sin(0.3)!r} * 0.5 * y + 3 AS ax, {math.sin(0.3)!r} * 1.5 * x + {math.cos(0.3)!r} * 0.5 * y - 2 AS ay FROM pt2),
    s AS (SELECT atan2(covar_pop(bx, ay) - covar_pop(by_, ax), covar_pop(bx, ax) + covar_pop(by_, ay)) AS a, avg(ax) AS max_, avg(ay) AS may, avg(bx) AS mbx, avg(by_) AS mby FROM q)
    SELECT round(a, 6) AS angle, round(max_ - cos(a) * mbx + sin(a) * mby, 5) AS tx, round(may - sin(a) * mbx - cos(a) * mby, 5) AS ty FROM s""")
def kabsch_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    T = register.find_rototranslation(_pairs(spark, sf_dir), ["ax", "ay"], ["bx", "by"])
    return spark.createDataFrame([(round(math.atan2(T[1, 0], T[0, 0]), 6), round(float(T[0, 2]), 5), round(float(T[1, 2]), 5))], "angle double, tx double, ty double")


@query()
def icp_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy of the suppliers, shifted, is brought back to them."""
    points = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") * 10.0).alias("x"), (F.col("s_acctbal") / 100).alias("y"))
    moved = points.select("id", (F.col("x") + 0.3).alias("x"), (F.col("y") - 0.2).alias("y"))
    found, _, history = register.icp({"a": points, "b": moved}, AXES, [2.0, 2.0], max_iter=8)
    return spark.createDataFrame([(n, float(T[0, 2]), float(T[1, 2]), len(history)) for n, T in found.items()], "name string, tx double, ty double, rounds int")


# Record tables.
@query("SELECT rec_id, x, y, z, 'scan' AS origin FROM forestscan UNION ALL SELECT rec_id, x, y, z, 'stem' AS origin FROM stemroots")
def merge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ["rec_id", "x", "y", "z"]
    return records.stack("origin", scan=records.subset(read(spark, sf_dir, "forestscan"), keep), stem=records.subset(read(spark, sf_dir, "stemroots"), keep))


@query("SELECT s.scan_id, s.sensor, c.n FROM scans s JOIN (SELECT scan_id, count(*) AS n FROM georecords GROUP BY 1) c ON c.scan_id = s.scan_id")
def fuse_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "georecords").groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))
    return records.fuse(read(spark, sf_dir, "scans").select("scan_id", "sensor"), counts, "scan_id")


@query("SELECT rec_id, intensity, coalesce(intensity, 0) > 1000 AS bright, 0 AS red FROM georecords")
def add_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = read(spark, sf_dir, "georecords").select("rec_id", "intensity")
    return records.activate(records.add_fields(base, {"bright": F.coalesce("intensity", F.lit(0)) > 1000}), "red")


@query("SELECT vec_id, coords[1] AS \"coords.1\", coords[2] AS \"coords.2\", coords[3] AS \"coords.3\" FROM shapevectors WHERE len(coords) = 12 AND isfinite(coords[1]) AND isfinite(coords[2]) AND isfinite(coords[3])")
def unnest_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = records.unnest(read(spark, sf_dir, "shapevectors").where("size(coords) = 12").select("vec_id", "coords"), True, {"coords": 3})
    for i in (1, 2, 3):
        flat = flat.where(F.col(f"`coords.{i}`").isNotNull() & ~F.isnan(f"`coords.{i}`"))
    return flat


@query("SELECT rec_id FROM georecords WHERE intensity BETWEEN 100 AND 200")
def range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.range_filter(read(spark, sf_dir, "georecords"), "intensity", 100, 200).select("rec_id")


@query("SELECT vec_id AS id, i - 1 AS position FROM (SELECT vec_id, coords, unnest(generate_series(1, len(coords))) AS i FROM shapevectors) WHERE coords[i] BETWEEN 90 AND 95")
def array_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.array_range_filter(read(spark, sf_dir, "shapevectors").select(F.col("vec_id").alias("id"), "coords"), "coords", 90.0, 95.0)


@query("SELECT rec_id, x IS NULL OR isnan(x) AS no_x, classification IS NULL AS no_class FROM forestscan")
def missing_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "forestscan")
    return df.select("rec_id", records.missing("x", df.schema["x"].dataType).alias("no_x"), records.missing("classification", df.schema["classification"].dataType).alias("no_class"))


@query("SELECT 'int' AS x_type, 'smallint' AS c_type")
def smallest_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "georecords").select((F.coalesce("intensity", F.lit(0)) + 40000).alias("i"), (F.coalesce(F.col("classification"), F.lit(0)) + 1000).alias("c"))
    return spark.createDataFrame([(records.smallest_type(df, "i"), records.smallest_type(df, "c"))], "x_type string, c_type string")


@query("""SELECT scan_id, count(*) FILTER (return_num = 1) AS first_returns, count(*) FILTER (return_num = num_returns) AS last_returns, count(*) FILTER (num_returns = 1) AS only_returns,
    count(*) FILTER (classification = 2) AS ground, count(*) FILTER (classification IN (3, 4, 5)) AS vegetation FROM georecords GROUP BY 1""")
def las_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = {"first_returns": records.first_return(), "last_returns": records.last_return(), "only_returns": records.only_return(), "ground": records.ground(), "vegetation": records.vegetation()}
    return read(spark, sf_dir, "georecords").groupBy("scan_id").agg(*(F.count_if(c).alias(n) for n, c in counted.items()))


@query("SELECT rec_id, round(week(scan_date) * 604800 + gps_time, 4) AS seconds FROM georecords JOIN scans USING (scan_id)")
def gps_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = read(spark, sf_dir, "scans").select("scan_id", "scan_date")
    return read(spark, sf_dir, "georecords").join(dates, "scan_id").select("rec_id", F.round(records.total_gps_seconds(F.col("scan_date")), 4).alias("seconds"))


# Pipelines, files and streams.
@query()
def stem_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thinning, density, clusters and one line per cluster of the higher vegetation."""
    points = fs3(spark, sf_dir).where("classification in (4, 5)")
    thin = points.join(filters.greedy_ball(points, ["x", "y", "z"], 0.3), "id", "left_semi")
    dense = joins.ball_count(thin, thin, AXES, 1.0).where("n >= 3").select(F.col("q_id").alias("id"))
    kept = thin.join(dense, "id", "left_semi")
    labels = cluster.dbscan(kept, AXES, 3, 1.0).where("label >= 0")
    big = cluster.class_sizes(labels, min_size=5)
    grouped = kept.join(labels.select("id", "label"), "id").join(big.select("label"), "label")
    lines = estimate.lines_of(grouped, ["x", "y", "z"], ["label"])
    return lines.join(big, "label").select("label", "n", "origin", "vector")


@query("SELECT count(*) AS n, count(*) FILTER (classification = 5) AS n_five, CAST(coalesce(sum(intensity), 0) AS BIGINT) AS intensity FROM forestscan WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
def las_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.sources import las  # noqa: PLC0415

    path = f"{shared_folder(spark)}/fieldloom-roundtrip.las".removeprefix("file://")
    rows = read(spark, sf_dir, "forestscan").where("x is not null and y is not null and z is not null")
    las.write_las(rows.select("x", "y", "z", F.col("intensity").cast("int").alias("intensity"), "classification"), path, crs="EPSG:25832")
    back = las.load_las(spark, path)
    return back.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("classification") == 5).alias("n_five"), F.sum("intensity").cast("bigint").alias("intensity"))


@query(f"WITH {EV2} SELECT count(*) AS n FROM ev2")
def stream_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows counted by cell and day, as a stream would; here over the table."""
    got = voxel_windows(ev2(spark, sf_dir), AXES, T2, "ts", "1 day", "2 days")
    return got.agg(F.sum("n").alias("n"))
