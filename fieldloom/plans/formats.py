"""Round trips through the file formats over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import grid
from fieldloom.operators.frame import PointFrame
from fieldloom.plans.spatial import AXES, EV2, FS3, T2, ev2, fs3, query, read
from fieldloom.session import scratch

PLACED = "x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL"
SCAN = f"SELECT rec_id, x, y, z, intensity, classification FROM forestscan WHERE {PLACED}"


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "forestscan").where(PLACED).select("rec_id", "x", "y", "z", "intensity", "classification")


@query(SCAN)
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates as one array column, written as numbered columns and read again."""
    from fieldloom.sources import text  # noqa: PLC0415

    path = scratch(spark, ".csv")
    rows = _scan(spark, sf_dir).select("rec_id", F.array("x", "y", "z").alias("coords"), "intensity", "classification")
    text.write_csv(rows, path, sep=";", widths={"coords": 3})
    back = text.load_csv(spark, path, sep=";")
    return back.select(F.col("rec_id").cast("bigint").alias("rec_id"), *(F.col("coords")[i].alias(a) for i, a in enumerate("xyz")), F.col("intensity").cast("int").alias("intensity"), F.col("classification").cast("int").alias("classification"))


@query(SCAN)
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.sources import text  # noqa: PLC0415

    path = scratch(spark, ".json")
    rows = _scan(spark, sf_dir)
    text.write_json(rows, path)
    return text.load_json(spark, path, rows.schema.simpleString()[7:-1].replace(":", " ")).select(*rows.columns)


@query(f"SELECT rec_id, x, y, z, intensity, classification, 'EPSG:25832' AS crs FROM ({SCAN})")
def dump_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame with what is known about it."""
    from fieldloom.sources import text  # noqa: PLC0415

    path = scratch(spark, ".dump")
    text.dump(PointFrame(_scan(spark, sf_dir), ("x", "y", "z"), "rec_id", "EPSG:25832"), path)
    back = text.load_dump(spark, path)
    return back.df.select("rec_id", *back.axes, "intensity", "classification", F.lit(back.crs).alias("crs"))


@query(f"SELECT rec_id, x, y, z, coalesce(classification, 0) AS classification FROM forestscan WHERE {PLACED}")
def ply_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.sources import ply  # noqa: PLC0415

    path = scratch(spark, ".ply").removeprefix("file://")
    rows = _scan(spark, sf_dir).select("x", "y", "z", F.col("rec_id").cast("double").alias("rec_id"), F.coalesce("classification", F.lit(0)).cast("int").alias("classification"))
    ply.write_ply(rows, path)
    back = ply.load_ply(spark, path)
    return back.select(F.col("rec_id").cast("bigint").alias("rec_id"), "x", "y", "z", "classification")


@query(f"SELECT rec_id, coalesce(intensity, 0) AS intensity, coalesce(classification, 0) AS classification, TRUE AS near FROM forestscan WHERE {PLACED}")
def las_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record through a LAS file, told by its time stamp; places must come back within the file's scale of two millimetres."""
    from fieldloom.sources import las  # noqa: PLC0415

    path = scratch(spark, ".las").removeprefix("file://")
    scan = _scan(spark, sf_dir)
    rows = scan.select("x", "y", "z", F.coalesce("intensity", F.lit(0)).cast("int").alias("intensity"), F.coalesce("classification", F.lit(0)).cast("smallint").alias("classification"), F.col("rec_id").cast("double").alias("gps_time"))
    las.write_las(rows, path, crs="EPSG:25832")
    back = las.load_las(spark, path).select(F.col("gps_time").cast("bigint").alias("rec_id"), *(F.col(a).alias(f"{a}_") for a in "xyz"), "intensity", "classification")
    apart = F.greatest(*(F.abs(F.col(a) - F.col(f"{a}_")) for a in "xyz"))
    return back.join(scan.select("rec_id", "x", "y", "z"), "rec_id", "left").select("rec_id", "intensity", "classification", (apart <= 0.002).alias("near"))


@query(f"""WITH {EV2}, c AS (SELECT CAST(trunc(y / 64) AS INT) AS k0, CAST(trunc(x / 32) AS INT) AS k1, count(*) AS n FROM ev2 GROUP BY 1, 2)
    SELECT CAST(i AS INT) AS key_0, CAST(j AS INT) AS key_1, coalesce(n, -1) * 1.0 AS n, 'EPSG:25832' AS crs FROM generate_series(0, 8) a(i) CROSS JOIN generate_series(0, 22) b(j) LEFT JOIN c ON k0 = i AND k1 = j""")
def raster_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by cell as a raster file, empty cells as its value for no data."""
    from fieldloom.sources import tiff  # noqa: PLC0415

    path = scratch(spark, ".tif").removeprefix("file://")
    cells = grid.Grid(grid.voxelize(ev2(spark, sf_dir), AXES, T2, [F.count(F.lit(1)).alias("n")]), T2, (9, 23), "EPSG:25832")
    tiff.write_raster(cells, path, ["n"], no_data=-1.0)
    back = tiff.load_raster(spark, path)
    return back.df.select("key_0", "key_1", F.col("bands")[0].alias("n"), F.lit(back.crs).alias("crs"))


@query("""SELECT * FROM (VALUES ('tinyint', 2, 2, 8), ('smallint', 4, 2, 16), ('int', 6, 2, 32), ('float', 9, 3, 32), ('double', 10, 3, 64)) t(kind, las_code, raster_format, raster_bits)""")
def type_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of types in files."""
    from fieldloom.sources import text  # noqa: PLC0415

    schema = spark.sql("SELECT 1Y AS tinyint, 1S AS smallint, 1 AS int, CAST(1 AS FLOAT) AS float, 1D AS double").schema
    rows = [(f.name, text.las_code(f.dataType), *text.raster_code(f.dataType)) for f in schema.fields]
    return spark.createDataFrame(rows, "kind string, las_code int, raster_format int, raster_bits int")


@query("SELECT i AS id, TRUE AS inside, i = 2 AS keypoint, i = 1 AS synthetic, i * 1.0 AS values FROM generate_series(0, 999) g(i)")
def random_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic cloud: rows, extent and flags."""
    from fieldloom.sources import text  # noqa: PLC0415

    df = text.random_records(spark, 1000, (10.0, 20.0, 30.0), 5.0).df
    inside = F.col("x").between(10, 15) & F.col("y").between(20, 25) & F.col("z").between(30, 35)
    return df.select("id", inside.alias("inside"), "keypoint", "synthetic", "values")


@query(f"WITH {FS3} SELECT count(*) AS n, 3 AS dim, 'EPSG:25832' AS crs, min(x) AS low_x, max(z) AS high_z, count(*) FILTER (classification = 5) AS five FROM fs3")
def frame_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a frame tells about its rows."""
    frame = PointFrame(fs3(spark, sf_dir), crs="EPSG:25832")
    box = frame.extent()
    return spark.createDataFrame([(frame.records().count(), frame.dim, frame.crs, box.low[0], box.high[2], frame.where("classification = 5").count())], "n bigint, dim int, crs string, low_x double, high_z double, five bigint")


@query(f"WITH {FS3}, s AS (SELECT id FROM fs3 WHERE classification = 4) SELECT id, x, y, z FROM fs3 JOIN s USING (id) UNION ALL SELECT id, x, y, z FROM fs3 JOIN s USING (id)")
def select_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by a list of ids in which each stands twice."""
    frame = PointFrame(fs3(spark, sf_dir), crs="EPSG:25832")
    ids = frame.df.where("classification = 4").select("id")
    return frame.select_ids(ids.unionByName(ids)).df.select("id", "x", "y", "z")
