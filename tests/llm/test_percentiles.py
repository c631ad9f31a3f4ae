"""Sketches: bounds, merging, and the exact checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import percentiles as P


def test_compaction_keeps_weight():
    rng = np.random.default_rng(1)
    group = rng.integers(0, 3, 20000)
    value = rng.random(20000)
    g, level, v, err2 = P.compact(group, np.zeros(20000, np.int8), value, 3, np.random.default_rng(2), 64)
    for i in range(3):
        assert (2.0 ** level[g == i]).sum() == (group == i).sum()
        assert max(np.bincount(level[g == i])) <= 64
        for q in (0.1, 0.5, 0.9):
            cut = np.quantile(value[group == i], q)
            rank = (2.0 ** level[(g == i) & (v <= cut)]).sum()
            assert abs(rank - q * (group == i).sum()) <= 6.6 * np.sqrt(err2[i])


def records(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "scan_id bigint, classification smallint, intensity int, n string")


def test_bounds_and_merging(spark):
    rng = np.random.default_rng(3)
    rows = [(int(s), int(c), int(v)) for s, c, v in zip(rng.integers(0, 4, 30000) // 3, rng.integers(2, 4, 30000), rng.gamma(2, 200, 30000))]
    df = records(spark, rows).repartition(7)
    by_scan = P.merge_sketches(P.sketch(df, ["scan_id", "classification"], "intensity", k=128), ["scan_id", "classification"], k=128)
    both = P.quantiles(P.merge_sketches(by_scan, ["classification"], k=128), ["classification"], [0.05, 0.5, 0.95]).collect()
    for r in both:
        own = np.sort([v for _, c, v in rows if c == r.classification])
        assert r.n == len(own) and 0 < r.rank_error < 0.2 * len(own)
        for i, q in enumerate((0.05, 0.5, 0.95)):
            assert r[f"q{i}_lo"] <= np.quantile(own, q) <= r[f"q{i}_hi"] and r[f"q{i}_lo"] <= r[f"q{i}"] <= r[f"q{i}_hi"]


def test_small_groups_are_exact(spark):
    df = records(spark, [(1, 2, v) for v in (5, 1, 9, 7)] + [(1, None, 3), (2, 2, None)])
    got = {(r.scan_id, r.classification): r for r in P.quantiles(P.group_sketches(df), ["scan_id", "classification"], [0.5]).collect()}
    assert set(got) == {(1, 2)} and got[1, 2].q0 == 6 and got[1, 2].rank_error == 0
    assert P.group_sketches(df.where("scan_id > 9")).count() == 0


def test_unusual_groups(spark, monkeypatch):
    """Groups at, just beyond and just short of twice and half the median; one holds a third of the rows."""
    monkeypatch.setattr(P, "K", 64)
    rng = np.random.default_rng(5)
    rows = [(1, 3, int(v)) for v in rng.normal(1000, 100, 6000)] + [(2, 3, int(v)) for v in rng.normal(1000, 100, 9000)]
    for scan, level in ((10, 1950), (11, 2050), (12, 480), (13, 520), (14, 9000)):
        rows += [(scan, 3, int(v)) for v in rng.normal(level, 30, 60 if scan != 14 else 40)]
    rows += [(None, 3, 50)] * 5 + [(20, None, 1)] * 60 + [(21, 3, None)] * 60
    df = records(spark, rows)
    whole = np.median([v for _, c, v in rows if c == 3 and v is not None])
    want = set()
    for scan in {s for s, *_ in rows if s is not None}:
        own = [v for s, c, v in rows if s == scan and c == 3 and v is not None]
        if len(own) >= 50 and (np.median(own) >= 2 * whole or 2 * np.median(own) <= whole):
            want.add((scan, 3))
    assert {(r.scan_id, r.classification) for r in P.unusual_groups(df).collect()} == want and want
    assert P.unusual_groups(df.where("scan_id = 99")).count() == 0


def test_exact_medians(spark):
    rng = np.random.default_rng(6)
    values = rng.integers(0, 1000, 501)
    df = spark.createDataFrame([(1, int(v)) for v in values] + [(2, 4), (2, 8)], "g int, v int")
    bounds = spark.createDataFrame([(1, 450.0, 550.0), (2, 4.0, 8.0)], "g int, lo double, hi double")
    got = {r.g: r.median for r in P.exact_medians(df, bounds, ["g"], "v").collect()}
    assert got == {1: pytest.approx(np.median(values)), 2: 6}
    assert P.exact_medians(df, bounds.where(F.lit(False)), ["g"], "v").count() == 0
