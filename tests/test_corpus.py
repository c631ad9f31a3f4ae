"""Unit conversion, proximity and line loading on small cases with known answers."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import projection
from fieldloom.operators import badrows, proximity, units

SITE = (1, 380000.0, 5410000.0, 100.0)
SCANS = [
    (1, 1, "EPSG:25832", None), (2, 1, None, None), (3, 1, "+proj=utm +zone=32 +units=ft +vunits=us-ft", None), (4, 1, "EPSG:25832", "Strip 2 only, heights in cm; others in m."),
    (5, 1, None, "Positions as integer 1e-7 deg, heights in m."), (6, 1, "EPSG:25832", "All coordinates in mm."), (7, 1, "+proj=utm +zone=32 +axis=neu +units=m", None), (8, 1, None, "Flown at 900 ft above ground, point spacing 8 cm."),
]
DEG = (7.364, 48.829)


@pytest.fixture(scope="module")
def tables(spark):
    e, n = (float(v[0]) for v in projection.east_north_arrays(np.array([DEG[0]]), np.array([DEG[1]]), np.array(["geo"], object), np.array([9.0]), np.array([0.9996]), np.array([5e5]), np.array([0.0])))
    sites = spark.createDataFrame([(1, e, n, 100.0, "s")], "site_id bigint, center_x double, center_y double, center_z double, scan_id string")
    scans = spark.createDataFrame([(*s, "extra") for s in SCANS], "scan_id bigint, site_id bigint, proj string, remark string, x string")
    rows = [
        (1, 1, e, n, 5.0, 0), (2, 1, e * 100, n * 100, 5.0, 0), (3, 2, e / 1000, n / 1000, 5.0, 0), (4, 3, e / 0.3048, n / 0.3048, 5.0, 0), (5, 4, e, n, 5.0, 2), (6, 4, e, n, 5.0, 1),
        (7, 5, DEG[0] * 1e7, DEG[1] * 1e7, 5.0, 0), (8, 6, e * 1000, n * 1000, 5.0, 0), (9, 7, n, e, 5.0, 0), (10, 8, e * 1000, n * 1000, 7.0, 0), (11, 1, None, None, None, 0), (12, 1, 1.0, 1.0, 1.0, 0), (13, 99, e, n, 1.0, 0), (14, 1, float("nan"), n, 1.0, 0),
    ]
    records = spark.createDataFrame([(*r[:2], 1, *r[2:]) for r in rows], "rec_id bigint, scan_id bigint, site_id bigint, x double, y double, z double, pt_src_id int")
    return records, scans, sites, (e, n)


def test_units(tables):
    records, scans, sites, (e, n) = tables
    got = {r.rec_id: r for r in units.common_units(records, scans, sites).collect()}
    assert len(got) == 14
    want = {1: ("m", "m"), 2: ("cm", "cm"), 3: ("km", "km"), 4: ("ft", "us-ft"), 5: ("m", "cm"), 6: ("m", "m"), 7: ("1e-7 deg", "m"), 8: ("mm", "mm"), 9: ("m", "m"), 10: ("mm", "mm")}
    for i, pair in want.items():
        assert (got[i].h_unit, got[i].v_unit) == pair, i
        assert got[i].x_m == pytest.approx(e, abs=0.01) and got[i].y_m == pytest.approx(n, abs=0.01)
        assert not got[i].uncertain
    assert got[5].z_m == pytest.approx(0.05) and got[10].z_m == pytest.approx(0.007)
    assert got[11].basis == "none" and got[11].x_m is None and got[14].x_m is None
    assert got[12].uncertain and got[12].h_unit == "m"
    found = {r.rec_id for r in units.foreign_units(records, scans, sites).collect()}
    assert found == {2, 3, 4, 5, 7, 8, 10}
    assert units.common_units(records.where("rec_id < 0"), scans, sites).count() == 0


def test_mixture():
    offsets = np.array([0.0, -3.0, 2.0, 3.0])
    bins = np.array([0.0, 0.01, -3.0, 2.0, 3.0, 6.5])
    fit = units.fit_log_mixture(bins, np.array([500, 500, 30, 20, 100, 3.0]), offsets)
    assert fit["weights"][0] > 0.8 and fit["weights"][-1] < 0.05 and abs(fit["shift"]) < 0.02
    assert units.fit_log_mixture(np.array([]), np.array([]), offsets)["weights"].sum() == pytest.approx(1)


def test_proximity(spark, monkeypatch):
    rng = np.random.default_rng(3)
    at = np.column_stack([380000 + rng.random(400) * 30, 5410000 + rng.random(400) * 30]).round(3)
    rows = [(i, float(x), float(y), "EPSG:25832" if i % 2 else None, "z") for i, (x, y) in enumerate(at)]
    rows += [(500 + i, float(x), float(y), None, "copy") for i, (x, y) in enumerate(at[:20])] + [(900, None, 1.0, None, ""), (901, float("nan"), 1.0, None, "")]
    stems = spark.createDataFrame(rows, "rec_id bigint, x double, y double, proj string, rep string")
    box = "POLYGON ((380005 5410005, 380020 5410005, 380020 5410020, 380012 5410012, 380005 5410020))"
    plots = spark.createDataFrame([(1000, box, None), (1001, "nothing", None), (1002, None, None), (1003, "Polygon((1246725 17749000, 1246726 17749000, 1246726 17749001))", "+proj=utm +zone=32 +units=ft")], "plot_id bigint, ring string, proj string")
    monkeypatch.setattr(proximity, "CROWD", 1)
    monkeypatch.setattr(proximity.skewed_join, "__defaults__", (1,))
    got = {(r.kind, r.id_a, r.id_b) for r in proximity.near_and_within(stems, plots).collect()}
    clean = [(i, x, y) for i, x, y, *_ in rows if x is not None and x == x]
    near = {("near", min(i, j), max(i, j)) for i, x, y in clean for j, u, v in clean if i < j and (x - u) ** 2 + (y - v) ** 2 <= 1}
    ring = proximity.read_ring(box, None)
    inside = {("within", i, 1000) for i, x, y in clean if proximity._inside(x, y, ring, np.roll(ring, -1, axis=0))}
    assert got == near | inside
    assert proximity.near_and_within(stems.where("rec_id < 0"), plots).count() == 0


def test_wide_regions(spark):
    """A ring with one vertex far away is covered in few ranges, beside a small one."""
    far = np.array([(380000.0, 5410000.0), (380100.0, 5410000.0), (3000000.0, 2000000.0)])
    assert proximity.block_level(far) > proximity.BLOCKS[0] and len(proximity.cover_ring(far, proximity.block_level(far))) < 400
    text = "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in far) + "))"
    plots = spark.createDataFrame([(1, text, None), (2, "POLYGON ((380000 5410000, 380100 5410000, 380100 5410100))", None), (3, "POLYGON ((1 1, 1e9 1, 1 1e9))", None)], "plot_id bigint, ring string, proj string")
    rng = np.random.default_rng(2)
    at = np.concatenate([[380000, 5410000] + rng.random((80, 2)) * 200 - 50, [400000, 5380000] + rng.random((80, 2)) * 9e4 - 4e4])
    places = spark.createDataFrame([(i, float(x), float(y), 1) for i, (x, y) in enumerate(at)], "rep bigint, east double, north double, copies bigint")
    got = {(r.rep, r.plot_id) for r in proximity.within_regions(places, plots).collect()}
    want = {(i, 1) for i in np.flatnonzero(proximity._inside(at[:, 0], at[:, 1], far, np.roll(far, -1, axis=0)))} | {(i, 2) for i, (x, y) in enumerate(at) if x <= 380100 and y - 5410000 <= x - 380000 and y >= 5410000}
    assert got == want and {p for _, p in want} == {1, 2}


def test_morton_cover(spark):
    ring = np.array([(0.0, 0.0), (300.0, 20.0), (280.0, 310.0), (-50.0, 200.0)])
    cover = proximity.cover_ring(ring, 6)
    assert all(lo < hi and lo >> 12 == (hi - 1) >> 12 for lo, hi, _ in cover)
    rng = np.random.default_rng(1)
    for x, y in rng.uniform(-100, 350, (300, 2)):
        code = proximity.morton_number(int(np.floor(x)) + proximity.OFFSET, int(np.floor(y)) + proximity.OFFSET)
        hit = [whole for lo, hi, whole in cover if lo <= code < hi]
        if proximity._inside(x, y, ring, np.roll(ring, -1, axis=0)):
            assert hit
        else:
            assert hit in ([], [False])
    df = spark.createDataFrame([(-3.5, 7.2)], "x double, y double").select(proximity.morton(F.col("x"), F.col("y")).alias("c"))
    assert df.first()["c"] == proximity.morton_number(-4 + proximity.OFFSET, 7 + proximity.OFFSET)


def test_hot_cells_of_places(spark, monkeypatch):
    monkeypatch.setattr(proximity, "HOT", 10)
    rng = np.random.default_rng(9)
    at = rng.random((80, 2)).round(3) * 1.5
    places = spark.createDataFrame([(i, 5e5 + float(x), 5e6 + float(y), 1) for i, (x, y) in enumerate(at)], "rep bigint, east double, north double, copies bigint")
    got = {(r.rep_a, r.rep_b) for r in proximity.near_links(places, 0.3).collect()}
    assert got == {(i, j) for i in range(80) for j in range(i + 1, 80) if ((at[i] - at[j]) ** 2).sum() <= 0.09}


LINES = [
    ("1,2,3,x", None), ('"1",2,3,x', None), ('1,2,3,"a ""b"" c"', None), ("+1, 2.5 ,3e2,", None), ("1,2,3", "column_count"), ("", "column_count"), ('1,2,3,"x', "quoting"), ('1,2,3,"x"y', "quoting"), ('1,2,3,x"', "quoting"),
    ("1,nan,3,x", "invalid_value"), ("1,,3,x", "invalid_value"), ("1,0x2,3,x", "invalid_value"), ("1,1e999,3,x", "invalid_value"), ("1,2,70000,x", "invalid_value"), ("1,2,NaN,x", None), ("1,2,2.5,x", "invalid_value"), ("1,2,-1,x", "invalid_value"), ("1,2,3,x\r", None), (' "1",2,3,x', "quoting"),
]


def test_lines(spark):
    names = ["coords.1", "coords.2", "intensity", "label"]
    for text, reason in LINES:
        if reason is None and "3e2" not in text:
            badrows.diagnose(text.removesuffix("\r"), ",", names)
    rows = [(1, 1, '﻿# coords.1,"coords.2",intensity,label\r')] + [(1, i + 2, text) for i, (text, _) in enumerate(LINES)] + [(1, 900 + i, "5,6,7,ok") for i in range(300)] + [(2, 2, "a"), (1, 2000, None), (3, 1, "label"), (3, 2, "t\tu")]
    lines = spark.createDataFrame(rows, "file_id bigint, line_no int, line string")
    files = spark.createDataFrame([(1, ",", "x"), (3, "\t", "y")], "file_id bigint, sep string, reason string")
    got = {(r.file_id, r.line_no): r for r in badrows.load_lines(lines, files).collect()}
    assert len(got) == len(LINES) + 303
    for i, (text, reason) in enumerate(LINES):
        want = "invalid_value" if "3e2" in text else reason
        assert got[1, i + 2].reason == want, text
    assert got[1, 4].label == 'a "b" c' and got[1, 950].x == 5 and got[1, 950].intensity == 7
    assert got[1, 16].intensity is None and got[2, 2].reason == "no_header" and got[1, 2000].reason == "column_count" and got[3, 2].reason == "column_count"
    assert badrows.load_lines(lines.where("file_id = 99"), files).count() == 0
    assert badrows.failed_lines(lines, files).columns == ["file_id", "line_no", "reason"]


def test_block_equals_strict():
    """Random lines: the bulk path and the strict one agree."""
    rng = np.random.default_rng(11)
    parts = ["1", "2.5", " 7 ", "-3e4", "nan", "", '"4"', '"a;b"', '"', "x", "+6", "inf", "1_0", "９", "٣", "1e", ".5", "5."]
    texts = [";".join(rng.choice(parts, rng.integers(2, 5))) for _ in range(600)]
    table = pa.table({"file_id": [1] * 600, "line_no": pa.array(range(2, 602), pa.int32()), "line": texts, "_head": ["coords.1;values;label"] * 600, "_sep": [";"] * 600})
    got = badrows.load_batch(table).to_pandas().set_index("line_no")
    for i, text in enumerate(texts):
        try:
            row = badrows.diagnose(text, ";", ["coords.1", "values", "label"])
        except badrows.BadLine as reason:
            assert got.loc[i + 2, "reason"] == str(reason), text
        else:
            assert got.loc[i + 2, "reason"] is None and got.loc[i + 2, "x"] == row["coords.1"] and got.loc[i + 2, "label"] == row["label"], text


def test_few_lines_are_diagnosed_singly(monkeypatch):
    """Of 5,000 lines with one bad in 40, at most twice as many as are bad leave the bulk path."""
    rng = np.random.default_rng(4)
    bad = ['1;2;"x', "1;2", "1;x;y", '1;2;a"b', "", "nan;2;z", '1;"2;x', "1;2;3;4"]
    texts = [bad[i % len(bad)] if i % 40 == 0 else rng.choice(['1.5;2;plain', '2;nan;"a;b"', ' 3 ;;"say ""so"""', "4e2;5;"]) for i in range(5000)]
    singly, parsed = [], []
    strict, block = badrows.diagnose, badrows._parse_block
    monkeypatch.setattr(badrows, "diagnose", lambda line, *rest: singly.append(line) or strict(line, *rest))
    monkeypatch.setattr(badrows, "_parse_block", lambda lines, *rest: parsed.append(len(lines)) or block(lines, *rest))
    table = pa.table({"file_id": [1] * 5000, "line_no": pa.array(range(2, 5002), pa.int32()), "line": texts, "_head": ["coords.1;values;label"] * 5000, "_sep": [";"] * 5000})
    got = badrows.load_batch(table).to_pandas()
    assert len(got) == 5000 and got["reason"].notna().sum() == 125
    assert len(singly) <= 250 and sum(parsed) >= 4800
    assert set(got.loc[got["reason"].isna(), "label"]) == {"plain", "a;b", 'say "so"', ""}


def test_failing_blocks_are_halved():
    """A line that passes the masks but that the bulk reader refuses is found by halving."""
    lines = pa.array(["1;a", "2;b", "3;c", "4;d", "5;e"])
    refuse, block = [], badrows._parse_block

    def parse(part, *rest):
        refuse.append(part.to_pylist())
        return None if "3;c" in part.to_pylist() else block(part, *rest)

    badrows._parse_block = parse
    try:
        good, bad = [], []
        badrows._bisect(lines, np.arange(5), ";", ["coords.1", "label"], good, bad)
    finally:
        badrows._parse_block = block
    assert ["3;c"] in refuse and not bad and sorted(int(k) for at, _ in good for k in at) == [0, 1, 2, 3, 4]


def test_units_that_reach_cannot_tell(spark):
    """A site near the origin: all four units put the rows within reach, or there is no centre; the mixture decides."""
    rng = np.random.default_rng(8)
    at = 1000 + rng.normal(0, 40, (300, 2))
    rows = [(i, 1 if i % 3 else 2, x * f, y * f) for i, (x, y) in enumerate(at.tolist()) for f in ([1, 0.001, 1000][i % 7 if i % 7 < 3 else 0],)]
    records = spark.createDataFrame([(i, 1, site, x, y, 1.0, 0) for i, site, x, y in rows] + [(900, 1, 1, 8e9, 8e9, 1.0, 0)], "rec_id bigint, scan_id bigint, site_id bigint, x double, y double, z double, pt_src_id int")
    scans = spark.createDataFrame([(1, None, None)], "scan_id bigint, proj string, remark string")
    sites = spark.createDataFrame([(1, 1000.0, 1000.0), (2, None, None)], "site_id bigint, center_x double, center_y double")
    got = {r.rec_id: r for r in units.common_units(records, scans, sites).collect()}
    for i, _, x, _ in rows:
        assert got[i].h_unit == {1: "km", 2: "mm"}.get(i % 7, "m") and got[i].basis == "position" and got[i].confidence > 0.99, i
        assert got[i].x_m == pytest.approx(at[i][0])
    assert got[900].uncertain and got[900].basis == "none"
