"""Sketches of different partitions are independent; medians outside their bounds are found."""

import numpy as np
from pyspark.sql import functions as F

from fieldloom.llm import percentiles as P


def test_partitions_take_their_own_starts(spark):
    df = spark.range(8 * 4000, numPartitions=8).selectExpr("1 as g", "id % 4000 as v")
    parts = P.sketch(df, ["g"], "v", k=64).collect()
    assert len(parts) == 8 and len({tuple(sorted(r["items"])) for r in parts}) > 1


def test_exact_medians_outside_their_bounds(spark):
    values = [int(v) for v in np.random.default_rng(7).integers(0, 1000, 500)]
    df = spark.createDataFrame([(g, v) for g in (1, 2, 3, 4) for v in values], "g int, v int")
    cut = float(np.floor(np.median(values)))
    bounds = spark.createDataFrame([(1, 900.0, 950.0), (2, 10.0, 50.0), (3, 400.0, 600.0), (4, 10.0, cut - 100)], "g int, lo double, hi double")
    assert {r.g: r.median for r in P.exact_medians(df, bounds, ["g"], "v").collect()} == dict.fromkeys((1, 2, 3, 4), np.median(values))


def test_even_groups_of_few_rows_are_not_unusual(spark):
    """One scan and class with an even number of rows equals its class, also where others are unusual."""
    schema = "scan_id bigint, classification smallint, intensity int"
    assert P.unusual_groups(spark.createDataFrame([(1, 2, v) for v in range(1, 61)], schema)).count() == 0
    rows = [(1, 2, v) for v in range(1, 61)] + [(2, 2, v) for v in range(1, 61)] + [(3, 2, 10 * v) for v in range(1, 61)]
    assert [tuple(r) for r in P.unusual_groups(spark.createDataFrame(rows, schema)).collect()] == [(3, 2)]


def test_bound_of_equal_partitions(spark):
    """Partitions of equal values: their errors must not add up beyond the bound."""
    parts = 128
    df = spark.range(parts * 1000, numPartitions=parts).selectExpr("1 as g", "id % 1000 as v")
    found = P.quantiles(P.merge_sketches(P.sketch(df, ["g"], "v", k=64), ["g"], k=64), ["g"], [0.1, 0.5, 0.9])
    assert 0 < found.first().rank_error < 0.2 * parts * 1000
    assert [(r.n, r.kept) for r in P.rank_check(df, found, ["g"], "v", [0.1, 0.5, 0.9]).collect()] == [(parts * 1000, True)]
    wrong = found.withColumns({"rank_error": F.col("rank_error") * 0, "q1": F.col("q1") + 30})
    assert not P.rank_check(df, wrong, ["g"], "v", [0.1, 0.5, 0.9]).first().kept
