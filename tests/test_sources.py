"""Round trips of the file formats, and the stream."""

import struct
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import affine
from fieldloom.operators.frame import Extent
from fieldloom.operators.grid import Grid
from fieldloom.sources import las, ply, text, tiff
from fieldloom.sources.base import GeoFile
from fieldloom.streaming.voxels import voxel_windows


def test_las(spark, tmp_path):
    frame = text.random_records(spark, 1000, (332592.88, 5513244.80, 120.0))
    rows = frame.df.withColumns({"return_num": F.lit(1).cast("smallint"), "num_returns": F.lit(2).cast("smallint"), "gps_time": F.lit(12.5)})
    path = str(tmp_path / "a.las")
    las.write_las(rows, path, crs="EPSG:25832", date=datetime(2020, 3, 4))
    head = las.read_header(path)
    assert len(head) == 1000 and head.crs == "EPSG:25832" and head.date == datetime(2020, 3, 4) and head.corners.shape == (8, 3)
    back = las.load_las(spark, path)
    a, b = (df.agg(F.sum("x").alias("x"), F.count_if("synthetic").alias("s"), F.count_if("keypoint").alias("k"), F.sum("classification").alias("c"), F.sum("intensity").alias("i")).first() for df in (rows, back))
    assert a.x == pytest.approx(b.x, abs=0.01) and (a.s, a.k, a.c, a.i) == (b.s, b.k, b.c, b.i) == (1, 1, b.c, b.i)
    assert back.where("num_returns = 2 and gps_time = 12.5").count() == 1000
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        middle = (head.extent.low[0] + head.extent.high[0]) / 2
        assert las.load_las(spark, path).where(F.col("x") > middle).count() == back.where(F.col("x") > middle).count()
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    with pytest.raises(ValueError):
        las.write_las(rows.withColumn("x", F.lit(None).cast("double")), path)


def test_ply(spark, tmp_path):
    df = text.random_records(spark, 300).df.select("x", "y", "z", "intensity", "values")
    path = str(tmp_path / "a.ply")
    ply.write_ply(df, path)
    back = ply.load_ply(spark, path)
    assert back.columns == ["x", "y", "z", "intensity", "values"]
    assert back.agg(F.sum("x"), F.sum("intensity")).first() == pytest.approx(df.agg(F.sum("x"), F.sum("intensity")).first())
    (tmp_path / "b.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar scalar_c\nend_header\n1 2 3 4\n5 6 7 8\n")
    assert [tuple(r) for r in ply.load_ply(spark, str(tmp_path / "b.ply")).orderBy("x").collect()] == [(1, 2, 3, 4), (5, 6, 7, 8)]


def test_raster(spark, tmp_path):
    t = affine.compose(t=[100, 200], s=[2, -2])
    cells = Grid.empty(spark, t, (5, 7), "EPSG:25832")
    cells = Grid(cells.df.withColumn("v", F.col("key_0") * 10.0 + F.col("key_1")).where("key_0 <> 4"), t, (5, 7), "EPSG:25832")
    path = str(tmp_path / "a.tif")
    tiff.write_raster(cells, path, ["v"], no_data=-1.0)
    back = tiff.load_raster(spark, path)
    assert back.shape == (5, 7) and np.allclose(back.t, t) and back.crs == "EPSG:25832"
    got = {(r.key_0, r.key_1): r.bands for r in back.df.collect()}
    assert got[2, 3] == [23.0] and got[4, 0] == [-1.0] and len(got) == 35
    part = tiff.load_raster(spark, path, Extent((102.5, 192.5), (108.5, 198.5)))
    assert part.shape == (3, 3) and part.df.count() == 9


def test_text(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.5, 2.5], "a"), (2, [3.5, 4.5], "b")], "id int, coords array<double>, label string")
    text.write_csv(df, str(tmp_path / "c"), widths={"coords": 2})
    back = text.load_csv(spark, str(tmp_path / "c")).orderBy("id").collect()
    assert [(r.id, r.coords, r.label) for r in back] == [(1, [1.5, 2.5], "a"), (2, [3.5, 4.5], "b")]
    text.write_json(df, str(tmp_path / "j"))
    assert text.load_json(spark, str(tmp_path / "j")).count() == 2
    frame = text.random_records(spark, 10)
    text.dump(frame, str(tmp_path / "d"))
    again = text.load_dump(spark, str(tmp_path / "d"))
    assert again.axes == frame.axes and again.crs == frame.crs and again.count() == 10
    assert text.raster_code(df.schema["id"].dataType) == (2, 32)
    with pytest.raises(ValueError):
        text.las_code(df.schema["label"].dataType)


def test_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(0, 1.0, 1.0, datetime(2024, 1, 1, 0, 5)), (1, 1.5, 1.0, datetime(2024, 1, 1, 0, 6)), (2, 9.0, 9.0, datetime(2024, 1, 1, 5, 0)), (3, 1.0, 1.0, datetime(2024, 1, 3))]
    spark.createDataFrame(rows, "id bigint, x double, y double, ts timestamp").write.parquet(folder)
    stream = spark.readStream.schema("id bigint, x double, y double, ts timestamp").parquet(folder)
    counted = voxel_windows(stream, ["x", "y"], affine.compose(s=[4, 4]), "ts", "1 hour", "1 hour")
    run = counted.writeStream.outputMode("append").format("memory").queryName("voxels").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    got = {(r.key_0, r.key_1): r.n for r in spark.table("voxels").collect()}
    assert got == {(0, 0): 2, (2, 2): 1}


def test_geofile(spark, tmp_path):
    rows = text.random_records(spark, 200, (100.0, 200.0, 10.0)).df.select("x", "y", "z", "intensity", "classification")
    path = str(tmp_path / "a.las")
    las.write_las(rows, path, crs="EPSG:25832")
    file = GeoFile(spark, path)
    box = Extent((100.0, 200.0), (105.0, 205.0))
    assert len(file) == 200 and file.crs == "EPSG:25832" and file.load().count() == 200
    assert file.load(box).count() == rows.where("x <= 105 and y <= 205").count() and 0 < file.load(box).count() < 200
    file.clean_cache()
    assert file.load().count() == 200
    with pytest.raises(ValueError):
        GeoFile(spark, "a.xyz")


def tiff_bytes(cells, tile, packed, predictor):
    """A raster of 16-bit numbers in square tiles (or strips, without ``tile``), by hand."""
    height, width, bands = cells.shape
    tall, wide = (tile, tile) if tile else (5, width)
    blocks = []
    for i in range(0, height, tall):
        for j in range(0, width, wide):
            block = np.zeros((tall if tile else min(tall, height - i), wide, bands), "<u2")
            part = cells[i:i + tall, j:j + wide]
            block[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                block[:, 1:] = block[:, 1:] - block[:, :-1]
            blocks.append(zlib.compress(block.tobytes()) if packed else block.tobytes())
    places = np.cumsum([8] + [len(b) for b in blocks]).tolist()
    tags = [(256, 3, [width]), (257, 3, [height]), (258, 3, [16] * bands), (259, 3, [8 if packed else 1]), (277, 3, [bands]), (317, 3, [predictor]), (339, 3, [1] * bands)]
    tags += [(322, 3, [tile]), (323, 3, [tile]), (324, 4, places[:-1]), (325, 4, [len(b) for b in blocks])] if tile else [(273, 4, places[:-1]), (278, 3, [tall]), (279, 4, [len(b) for b in blocks])]
    tags += [(33550, 12, [2.0, 2.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 100.0, 200.0, 0.0])]
    code = {3: "H", 4: "I", 12: "d"}
    at, out, tail = places[-1] + 2 + 12 * len(tags) + 4, [struct.pack("<H", len(tags))], []
    for tag, kind, values in sorted(tags):
        raw = struct.pack("<" + code[kind] * len(values), *values)
        out.append(struct.pack("<HHI", tag, kind, len(values)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", at + sum(map(len, tail)))))
        if len(raw) > 4:
            tail.append(raw)
    return struct.pack("<2sHI", b"II", 42, places[-1]) + b"".join([*blocks, *out, b"\0\0\0\0", *tail])


@pytest.mark.parametrize(("tile", "packed", "predictor"), [(16, True, 2), (16, False, 1), (0, True, 1), (0, True, 2), (0, False, 1)])
def test_raster_layouts(spark, tmp_path, tile, packed, predictor):
    """Tiles and strips, deflated or not, with and without differences, whole and by extent."""
    cells = np.random.default_rng(1).integers(0, 65536, (37, 21, 2))
    path = tmp_path / "a.tif"
    path.write_bytes(tiff_bytes(cells, tile, packed, predictor))
    got = {(r.key_0, r.key_1): r.bands for r in tiff.load_raster(spark, str(path)).df.collect()}
    assert len(got) == 37 * 21 and all(got[i, j] == cells[i, j].tolist() for i, j in got)
    part = tiff.load_raster(spark, str(path), Extent((104.5, 150.5), (120.5, 180.5)))
    i0, j0 = part.t[1, 2], part.t[0, 2]
    rows = part.df.collect()
    assert len(rows) == part.shape[0] * part.shape[1] > 0
    for r in rows:
        assert r.bands == cells[int((200 - i0) / 2) + r.key_0, int((j0 - 100) / 2) + r.key_1].tolist()
