"""Queries and operators do the whole job: no prefix of ids, no capped rounds."""

import os

import pytest

import __spark_entry__ as entry
from fieldloom.operators import filters
from fieldloom.plans import spatial


def test_dict_classes_takes_all_ids(spark, tmp_path):
    sizes = [i % 50 + 1 for i in range(4000)]
    spark.createDataFrame(list(enumerate(sizes)), "p_partkey bigint, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["id"]: r["label"] for r in spatial.dict_classes(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(sizes))


def test_dem_filter_takes_wide_patches(frame):
    """A raised strip that loses about one row of points a round."""
    at = [(x * 0.6, y * 0.6, 0.01 * (x * y % 3) + (1000.0 if x >= 6 else 0.0)) for x in range(66) for y in range(4)]
    kept = [r["id"] for r in filters.dem_filter(frame(at), ["x", "y", "z"], 0.5, tile=1000.0).collect()]
    assert kept and max(kept) < 24


def test_class_dict_all_has_large_labels(spark, tmp_path):
    sizes = [i % 5 for i in range(2000)]
    spark.createDataFrame(list(enumerate(sizes)), "p_partkey bigint, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["label"]: r["ids"] for r in entry.queries()["class_dict_all"](spark, str(tmp_path)).collect()}
    assert got == {label: list(range(label, 2000, 5)) for label in range(5)}


def test_cylinder_fit_takes_all_classes(spark):
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    rows = spatial.fs3(spark, folder).where("classification is not null").select("site_id", "classification").distinct()
    got = spatial.cylinder_fit(spark, folder).select("site_id", "classification")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in rows.collect()}
