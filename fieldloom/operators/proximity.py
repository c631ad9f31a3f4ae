"""Points near points and points in regions, by space-filling-curve codes.

Every position gets the Morton code of its cell of ``CELL`` metres. A disc or
region is covered by ranges of codes; ranges and points meet in an equi-join on
a coarse prefix of the code followed by ``lo <= code < hi``; candidates are
refined exactly. Equal positions are joined once, as one representative with
its members.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.projection import DEGREES, UNITS, cached_proj, east_north_arrays, with_east_north
from fieldloom.session import checkpoint, fence, sized_join, skewed_join

#: Edge of the finest cell in metres; a cell of level n has 2**n times that edge.
CELL = 1.0
#: Added to cell numbers so that they are positive within the projection's use.
OFFSET = 1 << 22
LEVELS = 25
#: A cell with more positions than this is joined by salts.
HOT = 4000
#: Members of a position above which they are met in shares.
CROWD = 5000
#: Levels of the cells that join regions and points, and the most of them that the box of a region may touch.
BLOCKS = (9, 13, 17, 21, 25)
TOUCHED = 64


def spread_bits(value: Column) -> Column:
    """Put a zero between the bits of a non-negative number below 2**32, by shifts and masks."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask))
    return value


def morton(x: Column, y: Column) -> Column:
    """Morton code of the finest cell of a position in metres."""
    cell = lambda c: F.floor(c / CELL).cast("bigint") + OFFSET
    return spread_bits(cell(x)) + 2 * spread_bits(cell(y))


def morton_number(ix: int, iy: int) -> int:
    """The same code for one cell, on the driver or in a task."""
    return int(format(ix, "b"), 4) + 2 * int(format(iy, "b"), 4)


def located(df: DataFrame, keep: list[str]) -> DataFrame:
    """Rows with east and north in EPSG:25832, each read under its own ``proj``.

    The distinct spellings are parsed once and joined back. A null or
    unreadable proj means EPSG:25832. Rows with null or NaN x or y are left out.
    """
    from fieldloom.operators.units import statement  # noqa: PLC0415

    named = df.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")).withColumn("_proj", F.coalesce("proj", F.lit("")))
    spellings = named.select("_proj").distinct().select("_proj", statement("_proj", F.lit(None).cast("string")).alias("_s")).select("_proj", "_s.p_kind", "_s.p_lon0", "_s.p_k0", "_s.p_x0", "_s.p_y0", "_s.p_h", "_s.p_swap")
    rows = sized_join(named.select(*keep, "x", "y", "_proj"), spellings, ["_proj"], "left", salt_by=keep[0], width=320)
    pairs = [F.lit(v) for item in (UNITS | DEGREES).items() for v in item]
    factor = F.coalesce(F.create_map(*pairs)[F.col("p_h")], F.lit(1.0))
    e, n = F.when(F.col("p_swap"), F.col("y")).otherwise(F.col("x")), F.when(F.col("p_swap"), F.col("x")).otherwise(F.col("y"))
    or_else = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    placed = with_east_north(rows, e * factor, n * factor, or_else("p_kind", "tm"), or_else("p_lon0", 9.0), or_else("p_k0", 0.9996), or_else("p_x0", 500000.0), or_else("p_y0", 0.0))
    return placed.where(F.col("east").isNotNull() & F.col("north").isNotNull()).select(*keep, "east", "north")


def positions(points: DataFrame, id: str = "rec_id") -> tuple[DataFrame, DataFrame]:
    """Distinct positions with their smallest id as ``rep``, and the membership (id, rep). ``points`` is read twice."""
    places = checkpoint(points.groupBy("east", "north").agg(F.min(id).alias("rep"), F.count(F.lit(1)).alias("copies")))
    members = skewed_join(points, places, ["east", "north"], "copies").select(F.col(id), "rep")
    return places, members


def with_members(left: DataFrame, members: DataFrame, places: DataFrame, name: str) -> DataFrame:
    """Join ``left`` (rep, ...) to the members of its positions as ``name``; members of crowded ones are met in shares."""
    named = members.select("rep", F.col(members.columns[0]).alias(name))
    crowded = places.where(F.col("copies") > CROWD).select("rep", F.ceil(F.col("copies") / CROWD).cast("int").alias("_n"))
    if not crowded.take(1):
        return left.join(named, "rep")
    one = F.coalesce(F.col("_n"), F.lit(1))
    spread = sized_join(left, crowded, ["rep"], "left", salt_by="rep").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_n")
    shares = sized_join(named, crowded, ["rep"], "left", salt_by=name).withColumn("_salt", F.pmod(F.xxhash64(name), one).cast("int")).drop("_n")
    return spread.join(shares, ["rep", "_salt"]).drop("_salt")


def range_join(points: DataFrame, ranges: DataFrame, levels: Sequence[int], salt_by: str) -> DataFrame:
    """Points whose ``code`` lies in ``[lo, hi)``; no range crosses a cell of its own ``level``.

    The level and the prefix of that level are the equi-join key; points are
    repeated for each of the ``levels`` that occur. The ranges are broadcast if
    their counted size allows, else both sides are shuffled with salts.
    """
    keyed = points.withColumn("level", F.explode(F.array(*(F.lit(v) for v in levels)))) if levels else points.withColumn("level", F.lit(0)).where(F.lit(False))
    keyed = keyed.withColumn("_block", F.expr("shiftright(code, 2 * level)"))
    cover = ranges.withColumn("_block", F.expr("shiftright(lo, 2 * level)"))
    return sized_join(keyed, cover, ["level", "_block"], "inner", salt_by=salt_by).where((F.col("code") >= F.col("lo")) & (F.col("code") < F.col("hi"))).drop("_block", "level")


def near_links(places: DataFrame, radius: float = 1.0) -> DataFrame:
    """Pairs of distinct positions at most ``radius`` apart: rep_a < rep_b and sd.

    Cells are at least four times the radius wide, so that the disc around a
    position touches four cells at most, and two or so on average; each of these
    is one range of codes. A cell
    with more than ``HOT`` positions is split by salts on the one side and
    repeated on the other.
    """
    level = max(0, math.ceil(math.log2(4 * radius / CELL)))
    edge = CELL * 2**level
    base = places.select("rep", "east", "north")
    home = base.withColumn("_cell", F.shiftright(morton(F.col("east"), F.col("north")), 2 * level))
    sides = lambda c: F.array_distinct(F.array(F.floor((F.col(c) - radius) / edge), F.floor((F.col(c) + radius) / edge)))
    disc = base.withColumn("_i", F.explode(sides("east"))).withColumn("_j", F.explode(sides("north")))
    start = OFFSET // 2**level
    disc = disc.select(F.col("rep").alias("rep_b"), F.col("east").alias("e_b"), F.col("north").alias("n_b"), (spread_bits(F.col("_i") + start) + 2 * spread_bits(F.col("_j") + start)).alias("_cell"))
    # Else the join's filter of nulls would be evaluated on the whole expression of the code, without common parts.
    home, disc = fence(home, "_cell"), fence(disc, "_cell")
    hot = checkpoint(home.groupBy("_cell").count().where(F.col("count") > HOT).select("_cell", F.ceil(F.col("count") / HOT).cast("int").alias("_n")))
    keys = ["_cell"]
    if hot.take(1):
        one, keys = F.coalesce(F.col("_n"), F.lit(1)), ["_cell", "_salt"]
        home = sized_join(home, hot, ["_cell"], "left", salt_by="rep").withColumn("_salt", F.pmod(F.xxhash64("rep"), one).cast("int")).drop("_n")
        disc = sized_join(disc, hot, ["_cell"], "left", salt_by="rep_b").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_n")
    dx, dy = F.col("east") - F.col("e_b"), F.col("north") - F.col("n_b")
    pairs = home.join(disc, keys).where(F.col("rep") < F.col("rep_b"))
    return pairs.select(F.col("rep").alias("rep_a"), "rep_b", (dx * dx + dy * dy).alias("sd")).where(F.col("sd") <= radius * radius)


_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")


def read_ring(ring: str | None, proj: str | None, density: int = 16) -> np.ndarray | None:
    """Vertices of a WKT polygon without holes in EPSG:25832, unclosed; None if unreadable."""
    if not isinstance(ring, str) or "polygon" not in ring.lower():
        return None
    values = np.array([float(v) for v in _NUMBER.findall(ring)], float)
    if len(values) < 6 or len(values) % 2:
        return None
    at = values.reshape(-1, 2)
    if np.array_equal(at[0], at[-1]):
        at = at[:-1]
    said = (cached_proj(proj) if isinstance(proj, str) else None) or {"kind": "tm", "lon0": 9.0, "k0": 0.9996, "x0": 500000.0, "y0": 0.0, "h": "m", "swap": False}
    if said["swap"]:
        at = at[:, ::-1]
    straight = said["kind"] == "tm" and said["lon0"] == 9.0
    if not straight:  # edges of another system are curves in the target
        step = np.linspace(0, 1, density, endpoint=False)[None, :, None]
        at = (at[:, None, :] * (1 - step) + np.roll(at, -1, axis=0)[:, None, :] * step).reshape(-1, 2)
    at = at * (UNITS | DEGREES)[said["h"]]
    full = lambda v, kind=float: np.full(len(at), v, dtype=kind)
    e, n = east_north_arrays(at[:, 0], at[:, 1], full(said["kind"], object), full(said["lon0"]), full(said["k0"]), full(said["x0"]), full(said["y0"]))
    out = np.column_stack([e, n])
    return out if len(out) >= 3 and np.isfinite(out).all() else None


def _crosses(boxes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which closed boxes (x0, y0, x1, y1) any edge a->b meets, in parts of bounded size."""
    out = np.zeros(len(boxes), bool)
    part = max(1, 1_000_000 // max(1, len(a)))
    for i in range(0, len(boxes), part):
        box = boxes[i:i + part, None, :]
        lo, hi = np.zeros((box.shape[0], len(a))), np.ones((box.shape[0], len(a)))
        ok = np.ones(lo.shape, bool)
        for axis in (0, 1):
            d, p = (b[:, axis] - a[:, axis])[None, :], a[:, axis][None, :]
            with np.errstate(divide="ignore", invalid="ignore"):
                t0, t1 = (box[..., axis] - p) / d, (box[..., axis + 2] - p) / d
            flat = np.broadcast_to(d == 0, lo.shape)
            ok &= ~flat | ((p >= box[..., axis]) & (p <= box[..., axis + 2]))
            lo = np.where(flat, lo, np.maximum(lo, np.minimum(t0, t1)))
            hi = np.where(flat, hi, np.minimum(hi, np.maximum(t0, t1)))
        out[i:i + part] = (ok & (lo <= hi)).any(axis=1)
    return out


def _inside(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Even-odd test of points against the ring of edges a->b."""
    x, y = np.atleast_1d(np.asarray(x, float)), np.atleast_1d(np.asarray(y, float))
    out = np.zeros(len(x), bool)
    part = max(1, 1_000_000 // max(1, len(a)))
    for i in range(0, len(x), part):
        u, v = x[i:i + part, None], y[i:i + part, None]
        turn = (a[None, :, 1] > v) != (b[None, :, 1] > v)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = (b[:, 0] - a[:, 0]) * (v - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
        out[i:i + part] = (turn & (u < at)).sum(axis=1) % 2 == 1
    return out


def block_level(at: np.ndarray) -> int:
    """Finest level of ``BLOCKS`` of which the box of a ring touches at most ``TOUCHED`` cells."""
    for level in BLOCKS:
        span = np.floor(at.max(axis=0) / (CELL * 2**level)) - np.floor(at.min(axis=0) / (CELL * 2**level)) + 1
        if span.prod() <= TOUCHED:
            return level
    return BLOCKS[-1]


def cover_ring(at: np.ndarray, block: int, budget: int = 160) -> list[tuple[int, int, bool]]:
    """Ranges (lo, hi, inner) of codes that cover a ring; none crosses a cell of level ``block``.

    Cells on the boundary are split, largest first, while fewer than ``budget``
    cells are open; cells wholly inside are marked, as they need no refinement.
    """
    a, b = at, np.roll(at, -1, axis=0)
    edge = CELL * 2**block
    low, high = np.floor(at.min(axis=0) / edge).astype(np.int64), np.floor(at.max(axis=0) / edge).astype(np.int64)
    cells = np.stack(np.meshgrid(np.arange(low[0], high[0] + 1), np.arange(low[1], high[1] + 1), indexing="ij"), axis=-1).reshape(-1, 2)
    inner, number, level = [], 0, block
    while True:
        w = CELL * 2**level
        on = _crosses(np.column_stack([cells * w, (cells + 1) * w]), a, b)
        off = cells[~on]
        whole = off[_inside((off[:, 0] + 0.5) * w, (off[:, 1] + 0.5) * w, a, b)]
        inner.append((level, whole))
        number += len(whole)
        cells = cells[on]
        if level == 0 or 4 * len(cells) + number > budget and level < block:
            break
        level -= 1
        cells = (2 * cells[:, None, :] + np.array([(0, 0), (0, 1), (1, 0), (1, 1)])[None]).reshape(-1, 2)
    start = lambda lv, c: morton_number(int(c[0]) * 2**lv + OFFSET, int(c[1]) * 2**lv + OFFSET)
    parts = [(lv, c, True) for lv, group in inner for c in group] + [(level, c, False) for c in cells]
    ranges = sorted((start(lv, c), start(lv, c) + 4**lv, whole) for lv, c, whole in parts)
    out: list[tuple[int, int, bool]] = []
    for lo, hi, whole in ranges:  # neighbours of one kind within a block become one range
        if out and out[-1][1] == lo and out[-1][2] == whole and out[-1][0] >> 2 * block == lo >> 2 * block:
            out[-1] = (out[-1][0], hi, whole)
        else:
            out.append((lo, hi, whole))
    return out


def region_ranges(plots: DataFrame) -> DataFrame:
    """One row per region: plot_id, the level of its blocks, its vertices and ranges of codes. Unreadable rings give none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for plot, proj, ring in zip(batch["plot_id"], batch["proj"], batch["ring"]):
                if (at := read_ring(ring, proj)) is not None and at.min() > -OFFSET * CELL and at.max() < (2**LEVELS - OFFSET) * CELL:
                    level = block_level(at)
                    cover = cover_ring(at, level)
                    rows.append((plot, level, at[:, 0].tolist(), at[:, 1].tolist(), [c[0] for c in cover], [c[1] for c in cover], [c[2] for c in cover]))
            yield pd.DataFrame(rows, columns=["plot_id", "level", "xs", "ys", "lo", "hi", "inner"]).astype({"level": "int32"})

    return plots.select("plot_id", "proj", "ring").mapInPandas(read, "plot_id bigint, level int, xs array<double>, ys array<double>, lo array<bigint>, hi array<bigint>, inner array<boolean>")


def in_ring(x: Column, y: Column, xs: Column, ys: Column) -> Column:
    """Even-odd test of a point against a ring, as an expression over the ring's arrays."""

    def step(odd: Column, i: Column) -> Column:
        j = F.when(i == 0, F.size(xs) - 1).otherwise(i - 1)
        x1, y1, x2, y2 = F.get(xs, i), F.get(ys, i), F.get(xs, j), F.get(ys, j)
        hit = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)
        return odd != F.coalesce(hit, F.lit(False))

    return F.aggregate(F.sequence(F.lit(0), F.size(xs) - 1), F.lit(False), step)


def within_regions(places: DataFrame, plots: DataFrame) -> DataFrame:
    """Pairs (rep, plot_id) of positions and the regions that contain them."""
    # Covering is Python work of a millisecond a region: a numbered repartition spreads it, and it is done once.
    spread = max(8, int(plots.sparkSession.conf.get("spark.sql.shuffle.partitions")), plots.sparkSession.sparkContext.defaultParallelism)
    regions = checkpoint(region_ranges(plots.repartition(spread, "plot_id")))
    levels = sorted(r["level"] for r in regions.select("level").distinct().collect())
    ranges = regions.select("plot_id", "level", F.explode(F.arrays_zip("lo", "hi", "inner")).alias("r")).select("plot_id", "level", "r.lo", "r.hi", "r.inner")
    coded = fence(places.select("rep", "east", "north").withColumn("code", morton(F.col("east"), F.col("north"))), "code")
    met = range_join(coded, ranges, levels, "rep")
    # One pass: the ring is tested only where the cell lies on the boundary.
    ringed = sized_join(met.select("rep", "plot_id", "east", "north", "inner"), regions.select("plot_id", "xs", "ys"), ["plot_id"], "inner", salt_by="rep", width=512)
    return ringed.where(F.col("inner") | in_ring(F.col("east"), F.col("north"), F.col("xs"), F.col("ys"))).select("rep", "plot_id")


def near_and_within(stems: DataFrame, plots: DataFrame, radius: float = 1.0) -> DataFrame:
    """All row pairs within ``radius`` (kind near, id_a < id_b) and all rows in regions (kind within).

    Rows of null or NaN coordinates take no part; repeated rows under different
    ids are rows of their own. Links are found between distinct positions and
    given back to their members here, because the result is one of rows; the
    operators before give representatives and membership. Empty inputs give an
    empty result, and other columns are not read.
    """
    points = checkpoint(located(stems.select("rec_id", "x", "y", "proj"), ["rec_id"]))
    places, members = positions(points)
    members = checkpoint(members)
    links = near_links(places, radius).select(F.col("rep_a").alias("rep"), "rep_b")
    apart = with_members(with_members(links, members, places, "a").select(F.col("rep_b").alias("rep"), "a"), members, places, "b")
    shared = members.join(places.where("copies > 1").select("rep"), "rep", "left_semi").select("rep", F.col("rec_id").alias("a"))
    same = with_members(shared, members, places, "b").where("a < b")
    near = apart.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).unionByName(same.select(F.col("a").alias("id_a"), F.col("b").alias("id_b")))
    held = with_members(within_regions(places, plots), members, places, "a")
    return near.select(F.lit("near").alias("kind"), "id_a", "id_b").unionByName(held.select(F.lit("within").alias("kind"), F.col("a").alias("id_a"), F.col("plot_id").alias("id_b")))
