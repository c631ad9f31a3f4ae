"""Nearest neighbours of array columns of many dimensions, in blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries compared with all vectors at once.
BLOCK = 20000


def top_rows(pairs: DataFrame, k: int) -> DataFrame:
    """The k smallest (sd, rep) of each qid."""
    window = Window.partitionBy("qid").orderBy("sd", "rep")
    return pairs.withColumn("_r", F.row_number().over(window)).where(F.col("_r") <= k).drop("_r")


def block_search(refs: DataFrame, queries: DataFrame, k: int, dim: int, block: int = BLOCK) -> DataFrame:
    """The k nearest of all vectors for every query, in blocks of about ``block`` queries: qid, rep, sd.

    ``refs`` has rep and coords, ``queries`` qid and q, arrays of ``dim``
    numbers. Each task compares its vectors with a block and gives back k rows
    a query; a block is the only thing sent to all tasks, and its size is fixed.
    A query does not find the vector of its own id; ties go to the smaller id.
    """
    count = queries.count()
    blocks = -(-count // block)
    out: DataFrame | None = None
    numbered = queries.select("qid", "q", F.pmod(F.xxhash64("qid"), F.lit(max(1, 2 * blocks))).alias("_b"))
    for b in range(2 * blocks):
        part = numbered.where(F.col("_b") == b).select("qid", F.col("q").cast("array<double>").alias("q")).toArrow().combine_chunks()
        if not part.num_rows:
            continue
        ids = part["qid"].to_numpy()
        at = part["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

        def run(batches: Iterator[pa.RecordBatch], ids=ids, at=at) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            best_d = np.full((len(ids), k), np.inf)
            best_i = np.full((len(ids), k), np.iinfo(np.int64).max)
            norm = (at * at).sum(axis=1)
            for batch in batches:
                x = batch.column("coords").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                rep = batch.column("rep").to_numpy()
                for lo in range(0, len(ids), 1000):
                    cut = slice(lo, lo + 1000)
                    rough = norm[cut, None] + (x * x).sum(axis=1)[None, :] - 2 * at[cut] @ x.T
                    # Rounding of the fast form is far below this slack; exact distances follow.
                    slack = 1e-6 * (1 + norm[cut, None])
                    row, col = np.nonzero(rough <= best_d[cut, -1:] + slack)
                    if not len(row):
                        continue
                    if len(row) > 4 * k * len(rough):
                        place = min(k, rough.shape[1] - 1)
                        kth = np.partition(rough, place, axis=1)[:, place]
                        row, col = np.nonzero((rough <= kth[:, None] + slack) & (rough <= best_d[cut, -1:] + slack))
                    sd = ((at[cut][row] - x[col]) ** 2).sum(axis=1)
                    other = ids[cut][row] != rep[col]
                    row, col, sd = row[other], col[other], sd[other]
                    every_r = np.concatenate([row, np.repeat(np.arange(len(rough)), k)])
                    every_d = np.concatenate([sd, best_d[cut].ravel()])
                    every_i = np.concatenate([rep[col], best_i[cut].ravel()])
                    order = np.lexsort((every_i, every_d, every_r))
                    every_r, every_d, every_i = every_r[order], every_d[order], every_i[order]
                    pick = np.searchsorted(every_r, np.arange(len(rough)))[:, None] + np.arange(k)
                    best_d[cut], best_i[cut] = every_d[pick], every_i[pick]
            q, j = np.nonzero(np.isfinite(best_d))
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best_i[q, j]), pa.array(best_d[q, j])], names=["qid", "rep", "sd"])

        columns = refs.select("rep", F.col("coords").cast("array<double>").alias("coords"))
        found = top_rows(columns.mapInArrow(run, "qid bigint, rep bigint, sd double"), k)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else refs.sparkSession.createDataFrame([], "qid bigint, rep bigint, sd double")
