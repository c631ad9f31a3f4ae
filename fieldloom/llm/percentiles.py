"""Percentiles per group by randomized compactor hierarchies.

A sketch of a group is a list of compactors. Level h holds at most ``K`` values
of weight 2**h. A full level is sorted, every second value from a random start
moves up with twice the weight, the others go. Sketches of parts are merged
level by level; each compaction of level h moves a rank by at most 2**h with
mean zero, so a sketch carries ``err2``, the sum of 4**h over its compactions,
from which a rank-error bound for any failure probability follows (Hoeffding).
A group that was never compacted answers exactly.

All groups of a partition are compacted together, as sorted arrays; there is no
loop over groups. Sketches are rows, so partitions, scans and days combine by
``merge_sketches``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.session import checkpoint, sized_join

#: Values per level before it is compacted.
K = 512
#: Failure probability of the bounds that the exact checks rely on.
DELTA = 1e-9
#: Rows held before a partition compacts what it has.
HOLD = 1 << 20

SKETCH = "n bigint, err2 double, items array<double>, levels array<tinyint>"


def compact(group: np.ndarray, level: np.ndarray, value: np.ndarray, groups: int, rng: np.random.Generator, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Compact every level with more than ``k`` values, from the lowest up, in all groups at once."""
    err2 = np.zeros(groups)
    out_g, out_l, out_v = [], [], []
    h = 0
    rest_g, rest_l, rest_v = group, level, value
    while len(rest_g):
        here = rest_l == h
        g, v = rest_g[here], rest_v[here]
        rest_g, rest_l, rest_v = rest_g[~here], rest_l[~here], rest_v[~here]
        count = np.bincount(g, minlength=groups)
        full = count > k
        stay = ~full[g]
        out_g.append(g[stay])
        out_v.append(v[stay])
        out_l.append(np.full(int(stay.sum()), h, np.int8))
        if full.any():
            g, v = g[~stay], v[~stay]
            order = np.lexsort((v, g))
            g, v = g[order], v[order]
            size = np.where(full, count, 0)
            begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            at = np.arange(len(g)) - begin[g]
            # An odd value out stays: the first or the last, by chance.
            odd = size % 2 == 1
            first = odd & (rng.integers(0, 2, groups) == 0)
            lone = np.where(first[g], at == 0, odd[g] & (at == size[g] - 1))
            out_g.append(g[lone])
            out_v.append(v[lone])
            out_l.append(np.full(int(lone.sum()), h, np.int8))
            start = rng.integers(0, 2, groups)
            up = ~lone & ((at - first[g] + start[g]) % 2 == 0)
            err2[full] += 4.0**h
            rest_g = np.concatenate([rest_g, g[up]])
            rest_v = np.concatenate([rest_v, v[up]])
            rest_l = np.concatenate([rest_l, np.full(int(up.sum()), h + 1, np.int8)])
        h += 1
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    return join(out_g, np.int64), join(out_l, np.int8), join(out_v, float), err2


class _Partition:
    """The sketches of all groups that a partition has seen."""

    def __init__(self, keys: list[str], k: int, step: int) -> None:
        # The bound needs starts that are independent between partitions and steps; a retried task takes the same ones.
        seed = [zlib.crc32("|".join(keys).encode()), step, TaskContext.get().partitionId()]
        self.keys, self.k, self.rng = keys, k, np.random.default_rng(seed)
        self.frame: pd.DataFrame | None = None  # keys, n, err2 by group
        self.parts: list[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: pd.DataFrame, n: np.ndarray, err2: np.ndarray, owner: np.ndarray, level: np.ndarray, value: np.ndarray) -> None:
        self.parts.append((keys, n, err2, owner, level, value))
        self.held += len(value)
        if self.held > HOLD:
            self.fold()

    def fold(self) -> None:
        if not self.parts:
            return
        keys = pd.concat([p[0] for p in self.parts], ignore_index=True)
        code = keys.groupby(self.keys, sort=False, dropna=False).ngroup().to_numpy()
        groups = int(code.max()) + 1 if len(code) else 0
        n = np.bincount(code, np.concatenate([p[1] for p in self.parts]), groups)
        err2 = np.bincount(code, np.concatenate([p[2] for p in self.parts]), groups)
        shift = np.cumsum([0] + [len(p[0]) for p in self.parts[:-1]])
        owner = code[np.concatenate([p[3] + s for p, s in zip(self.parts, shift)])]
        g, l, v, more = compact(owner, np.concatenate([p[4] for p in self.parts]), np.concatenate([p[5] for p in self.parts]), groups, self.rng, self.k)
        first = pd.Series(np.arange(len(code))).groupby(code).first().to_numpy()
        self.parts = [(keys.iloc[first].reset_index(drop=True), n, err2 + more, g, l, v)]
        self.held = len(v)

    def result(self) -> Iterator[pa.Table]:
        self.fold()
        if not self.parts:
            return
        keys, n, err2, g, l, v = self.parts[0]
        order = np.lexsort((v, g))
        g, l, v = g[order], l[order], v[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(g, minlength=len(keys)))])
        for at in range(0, len(keys), 2000):
            to = min(at + 2000, len(keys))
            offsets = pa.array((ends[at:to + 1] - ends[at]).astype(np.int32))
            cut = slice(ends[at], ends[to])
            table = pa.Table.from_pandas(keys.iloc[at:to], preserve_index=False)
            table = table.append_column("n", pa.array(n[at:to].astype(np.int64))).append_column("err2", pa.array(err2[at:to]))
            table = table.append_column("items", pa.ListArray.from_arrays(offsets, pa.array(v[cut])))
            yield table.append_column("levels", pa.ListArray.from_arrays(offsets, pa.array(l[cut].astype(np.int8))))


def _out(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + SKETCH


def _typed(table: pa.Table, kinds: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({n: table[n].cast(kinds[n]) if n in kinds else table[n] for n in table.schema.names})


def sketch(df: DataFrame, keys: Sequence[str], value: str, k: int = K) -> DataFrame:
    """One partial sketch for each group of each partition. Rows of null or NaN value are left out.

    Null keys form groups like others. Values are taken as doubles.
    """
    keys = list(keys)
    body = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_value")).where(~F.isnan("_value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, kinds = _Partition(keys, k, 1), {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            kinds = {n: table.schema.field(n).type for n in keys}
            rows = table.select(keys).to_pandas(integer_object_nulls=True)
            code, first = _groups(rows, keys)
            n = np.bincount(code, minlength=len(first)).astype(float)
            state.add(rows.iloc[first].reset_index(drop=True), n, np.zeros(len(first)), code, np.zeros(len(code), np.int8), table["_value"].to_numpy())
        for table in state.result():
            yield from _typed(table, kinds).to_batches()

    return body.mapInArrow(run, _out(df, keys))


def _groups(rows: pd.DataFrame, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    code = rows.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    first = pd.Series(np.arange(len(code))).groupby(code).first().to_numpy() if len(code) else np.empty(0, int)
    return code, first


def _merge_here(sketches: DataFrame, keys: list[str], k: int, step: int) -> DataFrame:
    """Merge the sketches that lie in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, kinds = _Partition(keys, k, step), {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            kinds = {n: table.schema.field(n).type for n in keys}
            rows = table.select(keys).to_pandas(integer_object_nulls=True)
            items, levels = table["items"].combine_chunks(), table["levels"].combine_chunks()
            size = np.diff(items.offsets.to_numpy())
            state.add(rows, table["n"].to_numpy().astype(float), table["err2"].to_numpy(), np.repeat(np.arange(len(rows)), size), levels.flatten().to_numpy(zero_copy_only=False), items.flatten().to_numpy(zero_copy_only=False))
        for table in state.result():
            yield from _typed(table, kinds).to_batches()

    return sketches.select(*keys, "n", "err2", "items", "levels").mapInArrow(run, _out(sketches, keys))


def merge_sketches(sketches: DataFrame, keys: Sequence[str], fan_in: int = 64, k: int = K) -> DataFrame:
    """One sketch per group of ``keys`` from any number of sketches of its parts.

    The sketches of a group first meet in ``fan_in`` shares by chance of their
    content and then once more, so that no task gets all parts of a hot group.
    """
    keys = list(keys)
    here = _merge_here(sketches, keys, k, 2)
    width = max(1, min(fan_in, int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    shared = here.withColumn("_share", F.pmod(F.xxhash64("n", "err2", F.slice("items", 1, 4)), F.lit(width)))
    once = _merge_here(shared.repartition(*keys, "_share"), keys, k, 3)
    return _merge_here(once.repartition(*keys), keys, k, 4)


def _positions(items: np.ndarray, weight: np.ndarray, owner: np.ndarray, groups: int, rank: np.ndarray) -> np.ndarray:
    """Value at a 0-based rank of every group; arrays are sorted by owner, value."""
    total = np.cumsum(weight)
    ends = np.cumsum(np.bincount(owner, weight, groups))
    begin = np.concatenate([[0.0], ends[:-1]])
    goal = begin + np.clip(rank, 0, np.maximum(ends - begin - 1, 0))
    return items[np.minimum(np.searchsorted(total, goal, side="right"), len(items) - 1)]


def quantiles(sketches: DataFrame, keys: Sequence[str], qs: Sequence[float], delta: float = DELTA) -> DataFrame:
    """Percentiles of every sketch, with value bounds that hold with probability 1 - ``delta``.

    For each q at index i: ``q{i}`` (linear between neighbouring ranks), and
    ``q{i}_lo``, ``q{i}_hi``, the values at the ranks below and above, moved out
    by ``rank_error`` rows (0 if the sketch is exact).
    """
    keys, qs = list(keys), [float(q) for q in qs]
    names = [f"q{i}{s}" for i in range(len(qs)) for s in ("", "_lo", "_hi")]
    schema = ", ".join(f"`{k}` {sketches.schema[k].dataType.simpleString()}" for k in keys) + ", n bigint, rank_error double, " + ", ".join(f"{n} double" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            items, levels = table["items"].combine_chunks(), table["levels"].combine_chunks()
            size = np.diff(items.offsets.to_numpy())
            owner = np.repeat(np.arange(len(size)), size)
            v, w = items.flatten().to_numpy(zero_copy_only=False), 2.0 ** levels.flatten().to_numpy(zero_copy_only=False)
            order = np.lexsort((v, owner))
            v, w, owner = v[order], w[order], owner[order]
            mass = np.bincount(owner, w, len(size))
            slack = np.ceil(np.sqrt(2 * math.log(2 / delta) * table["err2"].to_numpy()))
            out = table.select(keys).append_column("n", table["n"]).append_column("rank_error", pa.array(slack))
            for i, q in enumerate(qs):
                at = (mass - 1) * q
                low, high = (_positions(v, w, owner, len(size), f(at)) for f in (np.floor, np.ceil))
                mid = low + (high - low) * (at - np.floor(at))
                out = out.append_column(f"q{i}", pa.array(mid))
                for name, rank in ((f"q{i}_lo", np.floor(at) - slack), (f"q{i}_hi", np.ceil(at) + slack)):
                    out = out.append_column(name, pa.array(_positions(v, w, owner, len(size), rank)))
            yield from out.to_batches()

    return sketches.select(*keys, "n", "err2", "items", "levels").mapInArrow(run, schema)


def exact_medians(rows: DataFrame, bounds: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact medians of the groups in ``bounds`` (keys, lo, hi), whose interval should hold the median.

    Rows below the interval are counted, those inside by value; both are partial
    sums before the shuffle. Only the values inside are ordered, at most 65,536
    different ones for 16-bit values. Groups whose median lies outside are
    counted again over their full range.
    """
    keys = list(keys)
    found = checkpoint(_medians_within(rows, bounds, keys, value))
    inside = F.abs("median") < float("inf")
    missed = found.where(~inside).select(*keys, F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    if not missed.take(1):
        return found
    return found.where(inside).unionByName(_medians_within(rows, missed, keys, value))


def _medians_within(rows: DataFrame, bounds: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The same, with an infinite or NaN median where it lies outside its interval."""
    inside = sized_join(rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")), bounds.select(*keys, "lo", "hi"), keys, "inner", salt_by="_v")
    place = F.when(F.col("_v") < F.col("lo"), F.lit(float("-inf"))).when(F.col("_v") > F.col("hi"), F.lit(float("inf"))).otherwise(F.col("_v"))
    counts = inside.withColumn("_v", place).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    window = Window.partitionBy(*keys)
    run = counts.withColumns({"_n": F.sum("_c").over(window), "_to": F.sum("_c").over(window.orderBy("_v"))})
    low, high = F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)
    holds = lambda r: (F.col("_to") > r) & (F.col("_to") - F.col("_c") <= r)
    return run.groupBy(*keys).agg(((F.max(F.when(holds(low), F.col("_v"))) + F.max(F.when(holds(high), F.col("_v")))) / 2).alias("median"))


def group_sketches(records: DataFrame) -> DataFrame:
    """Sketches of intensity by scan and classification, of the rows that have both."""
    both = records.where(F.col("classification").isNotNull() & F.col("intensity").isNotNull())
    return merge_sketches(sketch(both, ["scan_id", "classification"], "intensity"), ["scan_id", "classification"])


def unusual_groups(records: DataFrame, least: int = 50, factor: float = 2.0) -> DataFrame:
    """Groups of scan and classification whose median is far from that of the classification.

    Far: at least ``factor`` times, or at most the ``factor``-th part; groups of
    fewer than ``least`` rows are left out. The sketches decide wherever their
    bounds leave no doubt; groups in doubt get exact medians. Rows of null
    classification or intensity take no part, those of null scan_id only in the
    medians of classifications; repeated rows count as
    they stand; an empty table gives an empty result.
    """
    by_scan = checkpoint(group_sketches(records))
    by_class = merge_sketches(by_scan, ["classification"])
    # Classifications are 16-bit numbers: at most 65,536 rows.
    whole = checkpoint(quantiles(by_class, ["classification"], [0.5]).select("classification", "rank_error", F.col("q0").alias("median"), F.col("q0_lo").alias("lo"), F.col("q0_hi").alias("hi")))
    sure = whole.where("rank_error = 0").select("classification", "median")
    exact = checkpoint(sure.unionByName(exact_medians(records, whole.where("rank_error > 0"), ["classification"], "intensity")))
    groups = quantiles(by_scan, ["scan_id", "classification"], [0.5]).where((F.col("n") >= least) & F.col("scan_id").isNotNull())
    judged = sized_join(groups, exact, ["classification"], salt_by="scan_id")
    far = lambda low, high: (low >= factor * F.col("median")) | (high * factor <= F.col("median"))
    # A sketch that was never compacted knows its median; it leaves no doubt.
    lo, hi = (F.when(F.col("rank_error") == 0, F.col("q0")).otherwise(F.col(c)) for c in ("q0_lo", "q0_hi"))
    judged = checkpoint(judged.withColumns({"_yes": far(lo, hi), "_maybe": far(hi, lo)}))
    doubt = judged.where("_maybe and not _yes").select("scan_id", "classification", F.col("q0_lo").alias("lo"), F.col("q0_hi").alias("hi"), F.col("median").alias("whole"))
    checked = exact_medians(records, doubt, ["scan_id", "classification"], "intensity").join(doubt.select("scan_id", "classification", "whole"), ["scan_id", "classification"])
    late = checked.where((F.col("median") >= factor * F.col("whole")) | (F.col("median") * factor <= F.col("whole")))
    return judged.where("_yes").select("scan_id", "classification").unionByName(late.select("scan_id", "classification"))


def rank_check(rows: DataFrame, found: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """Whether every percentile in ``found`` (from ``quantiles``) keeps its rank bound: keys, n, kept.

    The rows are counted against the estimates by partial sums: for each
    percentile the rows below and not above it. It keeps its bound if a rank
    within ``rank_error`` of the asked one lies between the two counts.
    """
    keys = list(keys)
    body = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).where(~F.isnan("_v"))
    met = sized_join(body, found.select(*keys, "rank_error", *(f"q{i}" for i in range(len(qs)))), keys, salt_by="_v")
    sums = [f(F.when(c, 1).otherwise(0)).alias(n) for i in range(len(qs)) for f, c, n in ((F.sum, F.col("_v") < F.col(f"q{i}"), f"_b{i}"), (F.sum, F.col("_v") <= F.col(f"q{i}"), f"_t{i}"))]
    counted = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("rank_error").alias("_e"), *sums)
    kept = F.lit(True)
    for i, q in enumerate(qs):
        at = (F.col("n") - 1) * F.lit(float(q))
        kept = kept & (F.col(f"_b{i}") <= F.ceil(at) + F.col("_e")) & (F.col(f"_t{i}") >= F.floor(at) + 1 - F.col("_e") - F.when(F.col("_e") == 0, 1).otherwise(0))
    return counted.select(*keys, "n", kept.alias("kept"))
