"""Sequential walks over points: parts that no pair within a radius connects, and the neighbourhoods of one part in memory."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.components import components
from fieldloom.session import checkpoint

#: Rows that small parts are walked by in one call, and neighbours that a walk keeps in memory.
BUCKET = 100_000
KEPT = 20_000_000
#: Links of cells up to which one task joins them; more are joined in rounds.
LINKS = 2_000_000


def _joined(links: pd.DataFrame) -> pd.DataFrame:
    """The smallest node that links (a, b) lead to, of each node."""
    nodes, code = np.unique(links[["a", "b"]].to_numpy(), return_inverse=True)
    a, b = code.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
    return pd.DataFrame({"node": nodes, "label": nodes[label]})


def in_parts(rows: DataFrame, axes: Sequence[str], r: float, links: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Add ``_part``: rows within r of each other have the same one.

    Rows are taken together by cells of edge r; occupied cells that touch are of
    one part, so no pairs are made. ``links`` gets the rows with their ``_cell``
    and returns further pairs (a, b) of cells that belong together. ``rows``
    should be a checkpoint, its coordinates not null.
    """
    edge = r * (1 + 1e-9) if r > 0 else 1.0
    names = [f"_c{i}" for i in range(len(axes))]
    number = F.xxhash64(*names)
    celled = rows.withColumns({c: F.floor(F.col(a) / edge).cast("bigint") for c, a in zip(names, axes)}).withColumn("_cell", number)
    cells = checkpoint(celled.select(*names, "_cell").distinct())
    steps = [s for s in product((-1, 0, 1), repeat=len(axes)) if s > (0,) * len(axes)]
    beside = F.explode(F.array(*(F.xxhash64(*(F.col(c) + s for c, s in zip(names, step))) for step in steps))).alias("b")
    touching = cells.select(F.col("_cell").alias("a"), beside).join(cells.select(F.col("_cell").alias("b")), "b", "left_semi").select("a", "b")
    if links is not None:
        touching = touching.unionByName(links(celled.drop(*names)))
    touching = checkpoint(touching)
    few = touching.count() <= LINKS
    joined = touching.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_joined, "node bigint, label bigint") if few else components(touching)
    found = joined.select(F.col("node").alias("_cell"), F.col("label").alias("_part"))
    parts = cells.select("_cell").distinct().join(found, "_cell", "left").select("_cell", F.coalesce("_part", "_cell").alias("_part"))
    return celled.drop(*names).join(parts, "_cell").drop("_cell")


def by_parts(rows: DataFrame, walk: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Walk rows with ``_part``; small parts share a call, as they do not meet."""
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BUCKET))
    return rows.withColumn("_part", F.pmod(F.xxhash64("_part"), F.lit(buckets))).groupBy("_part").applyInPandas(walk, schema)


class Near:
    """Points in memory: their positions, and what lies within r of a position."""

    def __init__(self, at: np.ndarray, r: float) -> None:
        edge = r * (1 + 1e-9) if r > 0 else 1.0
        self.square = r * r
        positions, of = np.unique(at + 0.0, axis=0, return_inverse=True)
        cells = np.floor(positions / edge).astype(np.int64)
        order = np.lexsort(cells.T[::-1])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        #: Position of each point; positions are numbered by cells.
        self.of = place[of.reshape(-1)]
        self.at, cells = positions[order], cells[order]
        low = cells.min(axis=0) - 1
        wide = (cells.max(axis=0) - low + 2).tolist()
        key = np.zeros(len(cells), object if np.prod([float(w) for w in wide]) > 2.0**62 else np.int64)
        for i, w in enumerate(wide):
            key = key * w + (cells[:, i] - low[i])
        # Cells that differ in the last axis only follow each other, so three of them are one range.
        self.ranges = []
        for step in product((-1, 0, 1), repeat=len(wide) - 1):
            shift = 0
            for s, w in zip((*step, 0), wide):
                shift = shift * w + s
            self.ranges.append((np.searchsorted(key, key + (shift - 1)), np.searchsorted(key, key + (shift + 1), side="right")))
        self.size = np.bincount(self.of, minlength=len(self.at))
        self.rows = np.argsort(self.of, kind="stable").astype(np.int32)
        self.start = np.cumsum(self.size) - self.size
        self._kept: dict[int, list[int] | np.ndarray] = {}
        self._room = KEPT

    def _keep(self, p: int, value: list[int] | np.ndarray) -> list[int] | np.ndarray:
        if self._room > 0:
            self._kept[p] = value
            self._room -= len(value)
        return value

    def _around(self, p: int) -> np.ndarray:
        near = np.concatenate([np.arange(a[p], b[p]) for a, b in self.ranges])
        total = np.zeros(len(near))
        for column, x in zip(self.at.T, self.at[p]):
            d = column[near] - x
            total += d * d
        return near[total <= self.square]

    def positions(self, p: int) -> list[int]:
        """Positions within r of position p, itself included."""
        got = self._kept.get(p)
        return got if got is not None else self._keep(p, self._around(p).tolist())

    def points(self, p: int) -> np.ndarray:
        """Points within r of position p, in their order. Use either this or ``positions`` of an instance."""
        got = self._kept.get(p)
        if got is not None:
            return got
        return self._keep(p, np.sort(np.concatenate([self.rows[self.start[q]:self.start[q] + self.size[q]] for q in self._around(p).tolist()])))

    def count(self) -> np.ndarray:
        """Number of points within r of each point."""
        return np.array([self.size[self._around(p)].sum() for p in range(len(self.at))], np.int64)[self.of]
