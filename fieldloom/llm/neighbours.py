"""The most similar vectors of every vector by multi-index hashing.

A rotation and thresholds learned on a bounded sample turn each vector into a
binary code: per rotated axis one bit for each threshold below the value. The
code is split into two substrings, each of six (half of the) axes, and each
substring is an index. By the pigeonhole principle two codes within Hamming
distance 2s + 1 agree in one substring up to distance s; so probing both
substrings up to s retrieves every code within that radius. Candidates are
reranked by their floats.

The number of thresholds grows with the number of vectors, so that a bucket
holds a few vectors at any size.

The margins to the thresholds bound how many bits a vector within a given
distance can differ in. A query whose k-th candidate is closer than the
cheapest way to differ in more bits than the radius is therefore finished and
exact. For the others the pigeonhole principle is applied to distances: a vector
closer than the k-th candidate has at most half of that squared distance in one
of the substrings' axes, so those buckets whose cheapest bit flips cost no more
are probed, cheapest axes first, and the list is complete. A query that would
need more than ``MOST`` buckets, or met fewer than k vectors, is compared with
all vectors in blocks, so that the result is exact.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.highdim import block_search, top_rows
from fieldloom.session import checkpoint, sized_join

DIM = 12
NEIGHBOURS = 5
#: Rows that the rotation and the thresholds are learned from, at most.
SAMPLE = 20000
#: Rows of one index bucket above which the bucket is joined by salts.
HOT = 3000
#: Vectors that an index bucket should hold, and the most thresholds an axis can have (20 bits, three axes to a number).
BUCKET = 3
LEVELS = 21
#: Buckets of one substring that a query may probe by distance.
MOST = 4096
#: Ids kept per distinct vector: one more than any row of an equal vector can need.
KEPT = NEIGHBOURS + 1


class Code:
    """Rotation and thresholds; ``half`` gives the axes of each substring."""

    def __init__(self, mean: np.ndarray, turn: np.ndarray, cuts: list[np.ndarray]) -> None:
        self.mean, self.turn, self.cuts = mean, turn, cuts
        axes = np.arange(len(cuts))
        self.half = [axes[0::2], axes[1::2]]

    @staticmethod
    def learn(sample: np.ndarray, rows: int) -> Code:
        """Principal axes, and as many equal-share thresholds as keep an index bucket small for ``rows`` vectors."""
        dim = sample.shape[1]
        mean = sample.mean(axis=0)
        values, vectors = np.linalg.eigh(np.atleast_2d(np.cov((sample - mean).T)) if len(sample) > 1 else np.eye(dim))
        turn = vectors[:, np.argsort(-values, kind="stable")]
        levels = int(np.clip(round((max(rows, 1) / BUCKET) ** (2 / dim)), 4, LEVELS))
        z = (sample - mean) @ turn
        cuts = [np.unique(np.quantile(z[:, i], np.linspace(0, 1, levels + 1)[1:-1])) for i in range(dim)]
        return Code(mean, turn, cuts)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Levels of every axis, and the cumulated least costs of differing in 1, 2, ... bits."""
        z = (x - self.mean) @ self.turn
        level = np.column_stack([np.searchsorted(c, z[:, i], side="left") for i, c in enumerate(self.cuts)]).astype(np.int64)
        costs = []
        for i, cut in enumerate(self.cuts):
            gap = cut[None, :] - z[:, i:i + 1]
            for side in (np.where(gap >= 0, gap, np.inf), np.where(gap < 0, -gap, np.inf)):
                square = np.sort(side, axis=1) ** 2
                with np.errstate(invalid="ignore"):
                    costs.append(np.diff(np.concatenate([np.zeros((len(x), 1)), square], axis=1), axis=1))
        step = np.sort(np.nan_to_num(np.concatenate(costs, axis=1), nan=np.inf, posinf=np.inf), axis=1)
        return level, np.cumsum(step, axis=1) * (1 - 1e-9)

    def key(self, level: np.ndarray, half: int) -> np.ndarray:
        """Number of an index bucket; substrings differ in the lowest bit."""
        key = np.zeros(level.shape[:-1], np.int64)
        for axis in self.half[half]:
            key = key * 32 + level[..., axis]
        return key * 2 + half

    def bits(self, level: np.ndarray) -> list[np.ndarray]:
        """The substrings themselves, two numbers each: the axes' thermometers of 20 bits."""
        out = []
        for half in self.half:
            for axes in (half[:3], half[3:]):
                bits = np.zeros(len(level), np.int64)
                for axis in axes:
                    bits = (bits << 20) | ((1 << level[:, axis]) - 1)
                out.append(bits)
        return out

    def near_boxes(self, x: np.ndarray, half: int, bound: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and bucket numbers of one substring whose cells are within the squared distance ``bound`` of each row.

        The third array tells the rows that would need more than ``most`` buckets; they get none.
        """
        z = (x - self.mean) @ self.turn
        rows, key, cost = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        over = np.zeros(len(x), bool)
        limit = bound * (1 + 1e-9) + 1e-12
        for axis in self.half[half]:
            cut = self.cuts[axis]
            # Distance of each row to each cell along this axis.
            edge = np.concatenate([[-np.inf], cut, [np.inf]])
            gap = np.maximum(np.maximum(edge[None, :-1] - z[:, axis:axis + 1], z[:, axis:axis + 1] - edge[None, 1:]), 0) ** 2
            total = cost[:, None] + gap[rows]
            at, level = np.nonzero(total <= limit[rows][:, None])
            cost, key, rows = total[at, level], key[at] * 32 + level, rows[at]
            over |= np.bincount(rows, minlength=len(x)) > most
            keep = ~over[rows]
            cost, key, rows = cost[keep], key[keep], rows[keep]
        return rows, key * 2 + half, over

    def probes(self, level: np.ndarray, half: int, near: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and bucket numbers of all substrings within distance ``near``."""
        axes = self.half[half]
        moves = [()]
        for size in range(1, near + 1):
            for steps in itertools.product(range(-near, near + 1), repeat=len(axes)):
                if sum(map(abs, steps)) == size:
                    moves.append(steps)
        rows, keys = [], []
        top = np.array([len(self.cuts[a]) for a in axes])
        for move in moves:
            there = level.copy()
            if move:
                there[:, axes] += np.array(move)
            ok = ((there[:, axes] >= 0) & (there[:, axes] <= top)).all(axis=1)
            rows.append(np.flatnonzero(ok))
            keys.append(self.key(there[ok], half))
        return np.concatenate(rows), np.concatenate(keys)


def valid_vectors(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """Rows (vec_id, coords) with exactly ``dim`` finite elements; negative zeros become zeros."""
    bad = F.exists("coords", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fit = F.when(F.size("coords") == dim, ~bad).otherwise(False)
    return vectors.where(F.col("coords").isNotNull() & fit).select("vec_id", F.transform("coords", lambda v: v + F.lit(0.0)).alias("coords"))


def distinct_vectors(valid: DataFrame, kept: int = KEPT) -> DataFrame:
    """One row per different vector: rep (smallest id), coords and its ``kept`` smallest ids.

    Only the smallest ids are ever neighbours, as ties go to the smaller id.
    Ids are cut to that number in shares first, so a vector that a third of all
    rows equal is never gathered whole.
    """
    shares = valid.withColumn("_s", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    ranked = shares.withColumn("_r", F.row_number().over(Window.partitionBy("coords", "_s").orderBy("vec_id"))).where(F.col("_r") <= kept)
    whole = ranked.groupBy("coords").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, kept).alias("ids"))
    return whole.select(F.col("ids")[0].alias("rep"), "coords", "ids")


def _square(a: str, b: str, dim: int) -> Column:
    total = F.lit(0.0)
    for i in range(dim):
        d = F.col(a)[i] - F.col(b)[i]
        total = total + d * d
    return total


_BITS = [f"b{i}" for i in range(4)]


def _encoded(reps: DataFrame, code: Code, radius: int, dim: int) -> DataFrame:
    """Vectors with substring numbers, substrings and the squared distance that ``radius`` makes safe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("coords").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            level, costs = code.encode(x)
            safe = costs[:, radius] if radius < costs.shape[1] else np.full(len(x), np.inf)
            arrays = [batch.column("rep"), batch.column("coords"), *(pa.array(a) for a in (code.key(level, 0), code.key(level, 1), *code.bits(level), safe))]
            yield pa.RecordBatch.from_arrays(arrays, names=["rep", "coords", "key0", "key1", *_BITS, "safe"])

    return reps.select("rep", "coords").mapInArrow(run, "rep bigint, coords array<double>, key0 bigint, key1 bigint, " + ", ".join(f"{b} bigint" for b in _BITS) + ", safe double")


def _probing(queries: DataFrame, code: Code, near: int, dim: int) -> DataFrame:
    """One row per query and bucket within ``near`` bits of a substring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                level, _ = code.encode(part.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                for half in (0, 1):
                    rows, keys = code.probes(level, half, near)
                    taken = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(keys)], names=[*taken.schema.names, "key"])

    columns = queries.select("qid", "q", *(F.col(b).alias(f"q{b}") for b in _BITS))
    return columns.mapInArrow(run, "qid bigint, q array<double>, " + ", ".join(f"q{b} bigint" for b in _BITS) + ", key bigint")


def _boxes(queries: DataFrame, code: Code, dim: int) -> DataFrame:
    """One row per query (qid, q, far) and bucket that can hold a vector nearer than ``far``; a null key if they are too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                x, far = part.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), part.column("far").to_numpy()
                found = [code.near_boxes(x, half, far / 2) for half in (0, 1)]
                over = found[0][2] | found[1][2]
                rows = np.concatenate([np.flatnonzero(over), *(r[~over[r]] for r, _, _ in found)])
                keys = np.concatenate([np.full(int(over.sum()), -1), *(k[~over[r]] for r, k, _ in found)])
                taken = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(keys, mask=keys < 0)], names=[*taken.schema.names, "key"])

    return queries.select("qid", "q", "far").mapInArrow(run, "qid bigint, q array<double>, far double, key bigint")


def _met(encoded: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes joined with the index; buckets of more than ``HOT`` vectors by salts."""
    index = encoded.select("rep", "coords", *_BITS, F.explode(F.array("key0", "key1")).alias("key"))
    hot = checkpoint(index.groupBy("key").count().where(F.col("count") > HOT).select("key", F.ceil(F.col("count") / HOT).cast("int").alias("_n")))
    if hot.take(1):
        one = F.coalesce(F.col("_n"), F.lit(1))
        index = sized_join(index, hot, ["key"], "left", salt_by="rep").withColumn("_salt", F.pmod(F.xxhash64("rep"), one).cast("int")).drop("_n")
        probes = sized_join(probes, hot, ["key"], "left", salt_by="qid").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_n")
        return probes.join(index, ["key", "_salt"]).where(F.col("qid") != F.col("rep"))
    return probes.join(index, "key").where(F.col("qid") != F.col("rep"))


def probe_join(encoded: DataFrame, queries: DataFrame, code: Code, near: int, k: int, dim: int) -> DataFrame:
    """The k best (qid, rep, sd) of all codes within Hamming distance 2 * near + 1 of each query."""
    away = [sum((F.bit_count(F.col(f"q{b}").bitwiseXOR(F.col(b))) for b in pair), F.lit(0)) for pair in (_BITS[:2], _BITS[2:])]
    # A pair that both substrings retrieve counts once, from the first.
    first = (F.col("key").bitwiseAND(F.lit(1)) == 0) | (away[0] > near)
    met = _met(encoded, _probing(queries, code, near, dim)).where((away[0] + away[1] <= 2 * near + 1) & first)
    return top_rows(met.select("qid", "rep", _square("q", "coords", dim).alias("sd")), k)


def box_join(encoded: DataFrame, boxes: DataFrame, k: int, dim: int) -> DataFrame:
    """The k best (qid, rep, sd) of all vectors not farther than ``far``, from ``boxes`` that cover that distance."""
    sd = _square("q", "coords", dim)
    met = _met(encoded, boxes.where("key is not null")).select("qid", "rep", "far", sd.alias("sd")).where("sd <= far")
    # Both substrings may retrieve a vector: equal places in the order are one vector.
    ranked = met.withColumn("_r", F.dense_rank().over(Window.partitionBy("qid").orderBy("sd", "rep"))).where(F.col("_r") <= k)
    return ranked.select("qid", "rep", "sd").distinct()


def nearest_vectors(reps: DataFrame, k: int = NEIGHBOURS, dim: int = DIM) -> DataFrame:
    """The k nearest other distinct vectors (qid, rep, sd) of every distinct vector; exact."""
    if dim > DIM:
        raise ValueError(f"codes take at most {DIM} axes")
    reps = checkpoint(reps)
    rows = reps.count()
    spark = reps.sparkSession
    if rows == 0:
        return spark.createDataFrame([], "qid bigint, rep bigint, sd double")
    # A bounded sample by hash, the same on every run.
    share = min(1.0, SAMPLE / rows)
    sample = reps.where(F.pmod(F.xxhash64("coords"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("coords").limit(2 * SAMPLE).toArrow().combine_chunks()
    points = sample["coords"].combine_chunks().flatten().to_numpy().reshape(-1, dim) if sample.num_rows else np.zeros((1, dim))
    code = Code.learn(points, rows)
    encoded = checkpoint(_encoded(reps, code, 3, dim))
    ask = encoded.withColumnsRenamed({"rep": "qid", "coords": "q"})
    first = checkpoint(probe_join(encoded, ask, code, 1, k, dim))
    left = _unfinished(first, encoded, k)
    boxes = checkpoint(_boxes(left.where("far is not null"), code, dim))
    second = box_join(encoded, boxes, k, dim)
    rest = checkpoint(left.where("far is null").select("qid", "q").unionByName(boxes.where("key is null").select("qid", "q")))
    last = block_search(reps, rest, k, dim)
    closed = first.join(left.select("qid"), "qid", "left_anti")
    return closed.unionByName(second).unionByName(last)


def _unfinished(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Queries whose k-th neighbour is not proven to be the k-th of all: qid, q, far (its squared distance, null if there is none)."""
    kth = found.groupBy("qid").agg(F.count(F.lit(1)).alias("_n"), F.max("sd").alias("far"))
    state = queries.select(F.col("rep").alias("qid"), F.col("coords").alias("q"), "safe").join(kth, "qid", "left").withColumn("far", F.when(F.col("_n") >= k, F.col("far")))
    return checkpoint(state.where(~F.coalesce(F.col("far") < F.col("safe"), F.lit(False))).select("qid", "q", "far"))


def neighbour_lists(vectors: DataFrame, k: int = NEIGHBOURS, dim: int = DIM) -> DataFrame:
    """For every valid row its k nearest other rows: vec_id, neighbours (array of sd, vec_id).

    Distances are Euclidean (squared here); ties go to the smaller vec_id. Rows
    whose array is null, empty, of another length or holds a null, NaN or
    infinite element take no part. Equal vectors are neighbours of each other at
    distance 0. With fewer than k other rows, all of them are neighbours; an
    empty table gives an empty result. vec_id is taken as unique.
    """
    valid = valid_vectors(vectors, dim)
    groups = checkpoint(distinct_vectors(valid, k + 1))
    near = nearest_vectors(groups.select("rep", "coords"), k, dim)
    ids = groups.select("rep", "ids")
    met = near.join(ids, "rep").select("qid", F.explode(F.transform("ids", lambda i: F.struct(F.col("sd").alias("sd"), i.alias("id")))).alias("c"))
    own = groups.select(F.col("rep").alias("qid"), F.explode(F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("sd"), i.alias("id")))).alias("c"))
    # At most k groups of k + 1 ids and the own ones: a bounded list for each vector.
    best = own.unionByName(met).groupBy("qid").agg(F.slice(F.array_sort(F.collect_list("c")), 1, k + 1).alias("best"))
    members = valid.join(groups.select("coords", "rep"), "coords").select("vec_id", "rep")
    mine = members.join(best.withColumnRenamed("qid", "rep"), "rep")
    return mine.select("vec_id", F.slice(F.filter("best", lambda c: c["id"] != F.col("vec_id")), 1, k).alias("neighbours"))


def nearest_pairs(vectors: DataFrame, k: int = NEIGHBOURS, dim: int = DIM) -> DataFrame:
    """Pairs vec_a < vec_b of which at least one is among the k nearest of the other."""
    lists = neighbour_lists(vectors, k, dim)
    pair = lists.select("vec_id", F.explode("neighbours.id").alias("other"))
    return pair.select(F.least("vec_id", "other").alias("vec_a"), F.greatest("vec_id", "other").alias("vec_b")).distinct()
