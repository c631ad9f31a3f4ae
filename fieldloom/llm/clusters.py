"""Similarity clusters by density peaks, made exact by joining linked peaks.

Equal positions are taken once, with their number of records. The density of a
record is the number of records within the radius of it, itself included; it
points to its nearest denser record within the radius (of equal density, the
smaller id counts as denser), records without one are peaks, and following the
pointers gives each record its peak. Peaks whose records are linked by a chain
are then joined, which makes the clusters the chains of records asked for.

Both neighbour joins are blocked: positions are gathered in cells so small that
all of a cell are within the radius of each other, and cells in tiles with a rim
that the radius can cross; all tiles of a task are joined at once. A tile of too
many positions is cut into shares that meet in pairs, so that no task gets an
unbounded tile.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.components import components, resolve_pointers
from fieldloom.session import checkpoint, sized_join, skewed_join

RADIUS = 0.6
CLASSES = (3, 4, 5)
#: Cells along the edge of a tile, and of the rim that any link can cross.
TILE = 16
RIM = 2
#: Positions of a tile above which it is cut into shares.
SHARE = 60000
#: Rows that a task joins at once, and pairs it expands at once.
ROWS = 100000
PAIRS = 1_000_000


def cell_edge(radius: float) -> float:
    """Edge of a cell whose diagonal is just below the radius."""
    return radius / math.sqrt(3) * (1 - 1e-9)


def celled(df: DataFrame, radius: float = RADIUS) -> DataFrame:
    """Rows with cell numbers cx, cy, cz; rows of null, NaN or infinite coordinates are left out."""
    h = cell_edge(radius)
    for c in "xyz":
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e12))
    return df.withColumns({f"c{c}": F.floor(F.col(c) / h).cast("bigint") for c in "xyz"})


class Block:
    """Positions of some tiles, sorted by cell, and their pairs in neighbouring cells."""

    def __init__(self, table: pa.Table, keys: list[str]) -> None:
        col = {n: table[n].to_numpy() for n in table.schema.names}
        change = np.zeros(table.num_rows, bool)
        for n in keys:
            change[1:] |= col[n][1:] != col[n][:-1]
        tile = np.cumsum(change)
        lx, ly = col["cx"] - col["tx"] * TILE + RIM, col["cy"] - col["ty"] * TILE + RIM
        # Heights are numbered without gaps beyond the rim, so that far strays cost nothing.
        levels, place = np.unique(col["cz"], return_inverse=True)
        gap = np.minimum(np.diff(levels, prepend=levels[:1]), RIM + 1)
        lz = np.cumsum(gap)[place]
        deep = int(lz.max()) + RIM + 1
        # One column of rim cells more on each side keeps neighbours from wrapping around.
        wide = TILE + 4 * RIM
        key = ((tile * wide + lx + RIM) * wide + ly + RIM) * deep + lz
        owned = (lx >= RIM) & (lx < RIM + TILE) & (ly >= RIM) & (ly < RIM + TILE)
        order = np.argsort(key, kind="stable")
        self.col = {n: v[order] for n, v in col.items()}
        self.owned = owned[order]
        self.xyz = np.column_stack([self.col[c] for c in "xyz"])
        self.cells, self.begin, self.count = np.unique(key[order], return_index=True, return_counts=True)
        # Shares of one tile meet in pairs; in a pair of two shares only rows of different ones meet.
        self.mixed = (self.col["pair"] >> 16) != (self.col["pair"] & 0xFFFF)
        span = range(-RIM, RIM + 1)
        self.deltas = [(i * wide + j) * deep + k for i in span for j in span for k in span if (i, j, k) > (0, 0, 0)]

    def pairs(self, inner: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of pairs with at least one owned, and their squared distances, some ``PAIRS`` at a time.

        Pairs within a cell come out only if ``inner`` is set.
        """
        a_all, b_all = [], []
        for delta in [0, *self.deltas] if inner else self.deltas:
            at = np.searchsorted(self.cells, self.cells + delta)
            a = np.flatnonzero((at < len(self.cells)) & (self.cells[np.minimum(at, len(self.cells) - 1)] == self.cells + delta))
            a_all.append(a)
            b_all.append(at[a])
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        mine = self.owned[self.begin]
        kept = mine[a] | mine[b]
        a, b = a[kept], b[kept]
        size = self.count[a].astype(np.int64) * self.count[b]
        # Parts of at most PAIRS pairs: several pairs of cells, or rows of the first cell of one pair.
        run, at = np.cumsum(size), 0
        while at < len(a):
            to = max(at + 1, int(np.searchsorted(run, (run[at - 1] if at else 0) + PAIRS, side="right")))
            first, last = self.count[a[at:to]], self.count[b[at:to]]
            step = max(1, PAIRS // int(last[0])) if to == at + 1 else int(first.max())
            for low in range(0, int(first.max()), step):
                n = np.minimum(first - low, step).astype(np.int64) * last
                end = np.cumsum(n)
                k = np.arange(end[-1]) - np.repeat(end - n, n)
                width = np.repeat(last, n)
                one, two = np.repeat(self.begin[a[at:to]] + low, n) + k // width, np.repeat(self.begin[b[at:to]], n) + k % width
                ok = ~self.mixed[one] | (self.col["share"][one] != self.col["share"][two])
                if inner:
                    ok &= (one < two) | np.repeat(a[at:to] != b[at:to], n)
                one, two = one[ok], two[ok]
                d = self.xyz[one] - self.xyz[two]
                yield one, two, (d * d).sum(axis=1)
            at = to

    def cell_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.cells)), self.count)


def _tiles(places: DataFrame, run: Callable[[Block, float], pa.RecordBatch], schema: str, radius: float, extra: list[str]) -> DataFrame:
    """Apply ``run`` to blocks of tiles with their rims; places have kind, rep, x, y, z, cx, cy, cz and ``extra``."""
    first = {"tx": F.floor(F.col("cx") / TILE), "ty": F.floor(F.col("cy") / TILE)}
    spread = lambda c: F.array_distinct(F.array(F.floor((F.col(c) - RIM) / TILE), F.floor(F.col(c) / TILE), F.floor((F.col(c) + RIM) / TILE)))
    rows = places.withColumn("tx", F.explode(spread("cx"))).withColumn("ty", F.explode(spread("cy")))
    count = places.groupBy("kind", *(e.alias(n) for n, e in first.items())).count()
    crowded = checkpoint(count.where(F.col("count") > SHARE).select("kind", "tx", "ty", F.ceil(F.col("count") / SHARE).cast("int").alias("_m")))
    rows = sized_join(rows, crowded, ["kind", "tx", "ty"], "left", salt_by="rep")
    m = F.coalesce("_m", F.lit(1))
    rows = rows.withColumn("share", F.pmod(F.xxhash64("rep"), m).cast("int")).withColumn("_t", F.explode(F.sequence(F.lit(0), m - 1)))
    rows = rows.withColumn("pair", F.least("share", "_t") * F.lit(1 << 16) + F.greatest("share", "_t"))
    keys = ["kind", "tx", "ty", "pair"]
    tiles = rows.select(*keys, "share", "rep", "x", "y", "z", "cx", "cy", "cz", *extra).repartition(*keys).sortWithinPartitions(*keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                last = [table[n][-1].as_py() for n in keys]
                same = np.ones(rows, bool)
                for n, v in zip(keys, last):
                    same &= table[n].to_numpy() == v
                to = int(np.argmax(same))  # the last tile may go on in the next batch
                if to:
                    yield run(Block(table.slice(0, to), keys), radius)
                    held, rows = table.slice(to).to_batches(), rows - to
        if rows:
            yield run(Block(pa.Table.from_batches(held), keys), radius)

    return tiles.mapInArrow(work, schema)


def _count_near(block: Block, radius: float) -> pa.RecordBatch:
    """Records within the radius of each owned position as (rep, null, near), and linked cells as (cell, other, 0)."""
    n, cell = block.col["n"], block.cell_of()
    near, links = np.zeros(len(n)), []
    # All of a cell are within the radius; in a pair of shares, those of the other share count.
    tag = block.mixed & (block.col["share"] == (block.col["pair"] & 0xFFFF))
    total, upper = np.bincount(cell, n), np.bincount(cell, n * tag)
    near += np.where(~block.mixed, total[cell], np.where(tag, total[cell] - upper[cell], upper[cell]))
    for one, two, sd in block.pairs(False):
        ok = sd <= radius * radius
        one, two = one[ok], two[ok]
        near += np.bincount(one, n[two], len(n)) + np.bincount(two, n[one], len(n))
        code = cell[one] * len(total) + cell[two]
        links.append(np.unique(code[np.concatenate([[True], code[1:] != code[:-1]])] if len(code) else code))
    mine = np.flatnonzero(block.owned & (near > 0))
    code = np.unique(np.concatenate(links)) if links else np.empty(0, np.int64)
    name = block.col["cell"][block.begin]
    a, b = name[code // len(total)], name[code % len(total)]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([block.col["rep"][mine], a])), pa.array(np.concatenate([np.full(len(mine), -1), b]), mask=np.arange(len(mine) + len(a)) < len(mine)), pa.array(np.concatenate([near[mine].astype(np.int64), np.zeros(len(a), np.int64)]))],
        names=["a", "b", "near"],
    )


def _nearest_denser(block: Block, radius: float) -> pa.RecordBatch:
    """For each owned position its nearest denser one within the radius: rep, parent, sd."""
    rep, dense = block.col["rep"], block.col["density"]
    best, parent = np.full(len(rep), np.inf), np.full(len(rep), -1, np.int64)
    for one, two, sd in block.pairs(True):
        ok = sd <= radius * radius
        one, two, sd = one[ok], two[ok], sd[ok]
        up = (dense[two] > dense[one]) | (dense[two] == dense[one]) & (rep[two] < rep[one])
        low, high = np.where(up, one, two), np.where(up, two, one)
        order = np.lexsort((rep[high], sd, low))
        low, high, sd = low[order], high[order], sd[order]
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else np.empty(0, np.int64)
        low, high, sd = low[first], high[first], sd[first]
        better = (sd < best[low]) | (sd == best[low]) & (rep[high] < parent[low])
        best[low[better]], parent[low[better]] = sd[better], rep[high[better]]
    mine = np.flatnonzero(block.owned & np.isfinite(best))
    return pa.RecordBatch.from_arrays([pa.array(rep[mine]), pa.array(parent[mine]), pa.array(best[mine])], names=["rep", "parent", "sd"])


def densities(points: DataFrame, radius: float = RADIUS) -> tuple[DataFrame, DataFrame]:
    """Distinct positions (kind, x, y, z, rep, n, cell, density), and links (a, b) between cells by their smallest rep.

    ``points`` have rec_id, kind, x, y, z and cell numbers.
    """
    places = points.groupBy("kind", "x", "y", "z", "cx", "cy", "cz").agg(F.min("rec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    places = checkpoint(places.withColumn("cell", F.min("rep").over(Window.partitionBy("kind", "cx", "cy", "cz"))))
    near = checkpoint(_tiles(places, _count_near, "a bigint, b bigint, near bigint", radius, ["n", "cell"]))
    dense = near.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("near").alias("density"))
    return checkpoint(places.join(dense, "rep")), near.where("b is not null").select("a", "b").distinct()


def density_peaks(records: DataFrame, radius: float = RADIUS, classes: tuple[int, ...] | None = CLASSES) -> DataFrame:
    """Every record with its cluster: rec_id, kind, x, y, z, density, denser, distance, peak, cluster_id, size.

    ``kind`` is the classification; records of other classes, or of null
    classification or coordinates, take no part. ``density`` counts the records
    within the radius, itself included; ``denser`` is the smallest rec_id at the
    nearest position of higher density (of equal density, the one of smaller
    id) within the radius and ``distance`` how far that is, both null for
    peaks; ``peak`` is the peak that the pointers lead to and ``cluster_id``
    the smallest rec_id of the cluster. Equal records under different ids are
    records of their own with one density and peak; an empty table gives an
    empty result.
    """
    kept = records.where(F.col("classification").isNotNull())
    if classes is not None:
        kept = kept.where(F.col("classification").isin(*classes))
    points = celled(kept.select("rec_id", F.col("classification").alias("kind"), "x", "y", "z"), radius)
    places, links = densities(points, radius)
    up = checkpoint(_tiles(places, _nearest_denser, "rep bigint, parent bigint, sd double", radius, ["density"]))
    # Shares of a crowded tile each know a nearest denser one.
    up = up.groupBy("rep").agg(F.min_by("parent", F.struct("sd", "parent")).alias("parent"), F.min("sd").alias("sd"))
    places = checkpoint(places.join(up, "rep", "left"))
    peaks = resolve_pointers(places.select(F.col("rep").alias("node"), F.coalesce("parent", "rep").alias("parent")))
    places = checkpoint(places.withColumnRenamed("parent", "denser").join(peaks.select(F.col("node").alias("rep"), F.col("parent").alias("peak")), "rep"))
    # A cell's records are all linked: its peaks are joined, and so are those of linked cells.
    cells = places.groupBy("cell").agg(F.min("peak").alias("_p"))
    inside = places.join(cells, "cell").where("peak <> _p").select(F.col("_p").alias("a"), F.col("peak").alias("b"))
    side = lambda s: cells.select(F.col("cell").alias(s), F.col("_p").alias(f"_{s}"))
    across = links.join(side("a"), "a").join(side("b"), "b").where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    merged = components(inside.unionByName(across).distinct()).select(F.col("node").alias("peak"), "label")
    # Sums by peak come before those by cluster.
    by_peak = places.groupBy("peak").agg(F.min("rep").alias("_least"), F.sum("n").alias("_n"))
    by_peak = checkpoint(by_peak.join(merged, "peak", "left").withColumn("label", F.coalesce("label", "peak")))
    named = by_peak.groupBy("label").agg(F.min("_least").alias("cluster_id"), F.sum("_n").alias("size"))
    known = by_peak.join(named, "label").select("peak", "cluster_id", "size")
    places = places.join(known, "peak").select("kind", "x", "y", "z", "n", "density", "denser", F.sqrt("sd").alias("distance"), "peak", "cluster_id", "size")
    rows = skewed_join(points.select("rec_id", "kind", "x", "y", "z"), checkpoint(places), ["kind", "x", "y", "z"], "n")
    return rows.select("rec_id", "kind", "x", "y", "z", "density", "denser", "distance", "peak", "cluster_id", "size")


def cluster_members(records: DataFrame, radius: float = RADIUS, least: int = 8) -> DataFrame:
    """One row (cluster_id, rec_id) for every record of each cluster of at least ``least`` records."""
    return density_peaks(records, radius).where(F.col("size") >= least).select("cluster_id", "rec_id")


def cluster_report(records: DataFrame, radius: float = RADIUS, least: int = 8, typical: int = 3) -> DataFrame:
    """Each cluster by its classification, size, peaks and most typical members.

    Typical members are the densest ones, of these the nearest to the cluster's
    mean position; at most ``typical``, in that order.
    """
    rows = checkpoint(density_peaks(records, radius).where(F.col("size") >= least))
    mean = rows.groupBy("cluster_id").agg(F.first("kind").alias("classification"), F.first("size").alias("size"), F.count_distinct("peak").alias("peaks"), *(F.avg(c).alias(f"mean_{c}") for c in "xyz"))
    away = sum((F.col(c) - F.col(f"mean_{c}")) ** 2 for c in "xyz")
    ranked = rows.join(mean.select("cluster_id", "mean_x", "mean_y", "mean_z"), "cluster_id")
    window = Window.partitionBy("cluster_id").orderBy(F.desc("density"), away, "rec_id")
    best = ranked.withColumn("_r", F.row_number().over(window)).where(F.col("_r") <= typical)
    members = best.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "rec_id"))), lambda s: s["rec_id"]).alias("typical"), F.max("density").alias("density"))
    return mean.join(members, "cluster_id").select("cluster_id", "classification", "size", "peaks", "density", "typical", *(F.round(f"mean_{c}", 3).alias(f"mean_{c}") for c in "xyz"))
