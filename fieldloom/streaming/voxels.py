"""Aggregation of point streams by cell and time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.grid import coords_to_keys


def voxel_windows(points: DataFrame, axes: Sequence[str], T: np.ndarray, time: str, window: str, late: str, aggregates: Sequence[Column] | None = None, slide: str | None = None) -> DataFrame:
    """Aggregates by cell and event-time window of a stream (or a table).

    Rows later than ``late`` behind the newest are dropped by the watermark, and
    state of windows that are past it is released. Partial aggregation runs
    before the shuffle on window and cell.
    """
    names = [f"key_{i}" for i in range(len(axes))]
    keyed = points.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    keyed = keyed.withColumns(dict(zip(names, coords_to_keys(T, axes))))
    span = F.window("_t", window, slide) if slide else F.window("_t", window)
    out = keyed.groupBy(span.alias("w"), *names).agg(*(aggregates or [F.count(F.lit(1)).alias("n")]))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])
