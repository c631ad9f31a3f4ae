"""Clustering and operations on class labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators import joins
from fieldloom.operators import walk as walks
from fieldloom.operators.components import components
from fieldloom.session import checkpoint, drop_checkpoint

#: Rows of a connected part up to which one task walks it; larger ones are walked in rounds.
WALKED = 2_000_000


def numbered(df: DataFrame, key: str, name: str = "number") -> DataFrame:
    """Distinct keys with their position in order, from 0: by ranges, with one count per range on the driver."""
    ranges = checkpoint(df.select(key).distinct().repartitionByRange(F.col(key)).withColumn("_p", F.spark_partition_id()))
    counts = sorted((r["_p"], r["count"]) for r in ranges.groupBy("_p").count().collect())
    start, rows = 0, []
    for p, n in counts:
        rows.append((p, start))
        start += n
    offsets = df.sparkSession.createDataFrame(rows, "_p int, _o bigint")
    local = ranges.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1)
    return local.join(F.broadcast(offsets), "_p").select(key, (F.col("_o") + F.col("_i")).alias(name))


def auto_epsilon(df: DataFrame, axes: Sequence[str], min_pts: int, quantile: float = 0.8, factor: float = 3.0, id: str = "id") -> float | None:
    """Radius from the distances of every row to its min_pts nearest other rows: their quantile times a factor."""
    near = joins.knn(df, df, axes, max(min_pts, 1), id, exclude_self=True)
    row = near.agg(F.percentile(F.sqrt("sd"), F.lit(float(quantile))).alias("e")).first()
    return None if row["e"] is None else float(row["e"]) * factor


def dbscan(df: DataFrame, axes: Sequence[str], min_pts: int, epsilon: float | None = None, id: str = "id", quantile: float = 0.8, factor: float = 3.0) -> DataFrame:
    """Density clusters: id, label, core. Labels are numbered from 0 by the smallest core id; noise is -1.

    A row is core if at least ``min_pts`` rows, itself included, are within
    ``epsilon``. Border rows take the lowest label of the core rows near them.
    Without ``epsilon`` it comes from ``auto_epsilon``. Rows of missing
    coordinates are noise. Equal rows are rows of their own.
    """
    if epsilon is None:
        epsilon = auto_epsilon(df, axes, min_pts, quantile, factor, id)
    if epsilon is None:
        return df.select(id, F.lit(-1).cast("bigint").alias("label"), F.lit(False).alias("core"))
    # No pair is written: the join is made three times, each time with fewer rows, and only its counts or minima are kept.
    rows = checkpoint(joins.points(df, axes, id).select(F.col("id").alias(id), *(F.col(str(i)).alias(f"_x{i}") for i in range(len(axes)))))
    at = [f"_x{i}" for i in range(len(axes))]
    cores = joins.ball(rows, rows, at, epsilon, id).groupBy("q_id").count().where(F.col("count") >= min_pts).select(F.col("q_id").alias(id))
    core = rows.join(cores, id, "left_semi")
    # All core rows of a cell of diagonal epsilon are linked: cells are joined, named by their smallest row.
    edge = epsilon / len(axes) ** 0.5 * (1 - 1e-9)
    cell = [f"_c{i}" for i in range(len(axes))]
    core = checkpoint(core.withColumns({c: F.floor(F.col(a) / edge) if edge > 0 else F.col(a) for c, a in zip(cell, at)}))
    core = checkpoint(core.join(core.groupBy(*cell).agg(F.min(id).alias("cell")), cell).drop(*cell))
    links = joins.ball(core, core, at, epsilon, id, carry=["cell"]).where("q_cell < r_cell").select(F.col("q_cell").alias("a"), F.col("r_cell").alias("b")).distinct()
    labels = core.select(F.col("cell").alias("node")).distinct().join(components(links), "node", "left").select(F.col("node").alias("cell"), F.coalesce("label", "node").alias("label"))
    labels = checkpoint(labels)
    core = checkpoint(core.join(labels.join(numbered(labels, "label"), "label").select("cell", "number"), "cell").select(id, *at, "number"))
    rest = rows.join(core.select(id), id, "left_anti").withColumn("number", F.lit(None).cast("bigint"))
    border = joins.ball(rest, core, at, epsilon, id, carry=["number"]).groupBy(F.col("q_id").alias(id)).agg(F.min("r_number").alias("label"))
    known = core.select(id, F.col("number").alias("label"), F.lit(True).alias("core")).unionByName(border.withColumn("core", F.lit(False)))
    return df.select(id).join(known, id, "left").select(id, F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("core", F.lit(False)).alias("core"))


def majority(df: DataFrame, group: Sequence[str], label: str, empty: int | str = -1) -> DataFrame:
    """Most frequent label of each group; a tie gives ``empty``. Null labels do not count."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*group, label).agg(F.count(F.lit(1)).alias("_c"))
    window = Window.partitionBy(*group)
    best = counts.withColumn("_best", F.max("_c").over(window)).where("_c = _best")
    return best.groupBy(*group).agg(F.when(F.count(F.lit(1)) == 1, F.first(label)).otherwise(F.lit(empty)).alias(label))


def majority_clusters(df: DataFrame, axes: Sequence[str], r: float, id: str = "id", order: Column | None = None, seeds: DataFrame | None = None, auto_set: bool = True) -> DataFrame:
    """Labels by majority of the labelled rows within r, in order: id, label.

    The order is by density (rows within r), densest first, then the higher id;
    or ascending by ``order``, then the lower id. ``seeds`` (id, label) are
    labels to start from. A row without labelled rows near it starts a cluster
    (if ``auto_set``); a tie leaves it at -1. Parts that no pair within r
    connects are walked apart, by one task each; only votes by position are
    kept. If a part has more than ``WALKED`` rows, all rows whose earlier
    neighbours are settled are settled in one round instead; rounds end after
    the longest chain.
    """
    return _walk_clusters(df, axes, r, lambda votes: majority(votes, ["q_id"], "label"), None, id, order, seeds, auto_set)


def _walk_majority(near: walks.Near, steps: np.ndarray, seed: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Labels of points in the order of ``steps``, by the votes of the positions near; -1 is no label."""
    label, of, new = seed.tolist(), near.of.tolist(), new.tolist()
    votes: list[dict[int, int]] = [{} for _ in range(len(near.at))]
    for p, c in zip(of, label):
        if c != -1:
            votes[p][c] = votes[p].get(c, 0) + 1
    for i in steps.tolist():
        p = of[i]
        total: dict[int, int] = {}
        for q in near.positions(p):
            for c, n in votes[q].items():
                total[c] = total.get(c, 0) + n
        if total:
            most = max(total.values())
            best = [c for c, n in total.items() if n == most]
            got = best[0] if len(best) == 1 else -1
        else:
            got = new[i]
        own, old = votes[p], label[i]
        if old != -1:
            own[old] -= 1
            if not own[old]:
                del own[old]
        if got != -1:
            own[got] = own.get(got, 0) + 1
        label[i] = got
    return np.array(label, np.int64)


def _walk_function(get_class: Callable[[list], int]) -> Callable[..., np.ndarray]:
    def run(near: walks.Near, steps: np.ndarray, seed: np.ndarray, new: np.ndarray) -> np.ndarray:
        label = seed.copy()
        for i in steps.tolist():
            seen = label[near.points(near.of[i])]
            seen = seen[seen != -1]
            label[i] = int(get_class(seen.tolist())) if len(seen) else new[i]
        return label

    return run


def _number_started(labels: DataFrame, rank: DataFrame, id: str, top: int) -> DataFrame:
    """Clusters named by their first row, below -1, numbered in the order in which they were started."""
    named = labels.where("label < -1").select((F.lit(-2).cast("bigint") - F.col("label")).alias("id")).distinct().join(rank, "id").select("id", "rank")
    numbers = numbered(named, "rank").join(named, "rank").select((F.lit(-2).cast("bigint") - F.col("id")).alias("label"), (F.col("number") + top + 1).alias("_to"))
    out = labels.join(numbers, "label", "left").select("id", F.coalesce("_to", "label").alias("label"))
    return out.select(F.col("id").alias(id), "label")


def _walk_parts(df: DataFrame, axes: Sequence[str], r: float, walk: Callable[..., np.ndarray], id: str, order: Column | None, seeded: DataFrame | None, top: int, auto_set: bool) -> DataFrame | None:
    """The walk of each part in memory; nothing if a part is too large for one task."""
    ordered = df.withColumn("_o", order if order is not None else F.lit(None).cast("double"))
    rows = joins.points(ordered, axes, id, "", ["_o"])
    rows = rows.join(seeded, "id", "left") if seeded is not None else rows.withColumn("label", F.lit(None).cast("bigint"))
    at = [str(i) for i in range(len(axes))]
    rows = rows.select("id", *at, F.coalesce("label", F.lit(-1)).cast("bigint").alias("label"), "_o", F.col("_o").isNotNull().alias("_has"))
    rows = checkpoint(walks.in_parts(checkpoint(rows), at, r))
    if rows.groupBy("_part").count().where(F.col("count") > WALKED).take(1):
        return None
    free = order is None

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        near = walks.Near(group[at].to_numpy(float), float(r))
        ids = group["id"].to_numpy()
        count = near.count() if free else np.zeros(len(ids), np.int64)
        # Densest first, then the higher id; or by the order, nulls first, then the lower id.
        steps = np.lexsort((-ids, -count)) if free else group.sort_values(["_has", "_o", "id"]).index.to_numpy()
        new = -2 - ids.astype(np.int64) if auto_set else np.full(len(ids), -1)
        return pd.DataFrame({"id": ids, "label": walk(near, steps, group["label"].to_numpy(np.int64), new), "_n": count})

    got = checkpoint(walks.by_parts(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, label bigint, _n bigint"))
    rank = got.select("id", F.struct((-F.col("_n")).alias("a"), (-F.col("id")).alias("b")).alias("rank")) if free else rows.select("id", F.struct(F.col("_o").alias("a"), F.col("id").alias("b")).alias("rank"))
    return _number_started(got.select("id", "label"), rank, id, top)


def _walk_clusters(df: DataFrame, axes: Sequence[str], r: float, vote: Callable[[DataFrame], DataFrame], walk: Callable[..., np.ndarray] | None, id: str, order: Column | None, seeds: DataFrame | None, auto_set: bool) -> DataFrame:
    """The walk by parts (``walk``, by default by majority), or rounds of it; ``vote`` turns (q_id, r_id, label) into one label for each q_id."""
    seeded, top = None, -1
    if seeds is not None:
        seeded = seeds.select(F.col(id).alias("id"), F.col("label").cast("bigint").alias("label")).where("label <> -1")
        top = seeded.agg(F.max("label").alias("m")).first()["m"]
        top = -1 if top is None else top
    got = _walk_parts(df, axes, r, walk or _walk_majority, id, order, seeded, top, auto_set)
    if got is not None:
        return got
    valid = joins.points(df, axes, id).select("id")
    pairs = checkpoint(joins.ball(df, df, axes, r, id).select("q_id", "r_id"))
    if order is None:
        rank = pairs.groupBy(F.col("q_id").alias("id")).agg(F.count(F.lit(1)).alias("_n")).select("id", F.struct((-F.col("_n")).alias("a"), (-F.col("id")).alias("b")).alias("rank"))
    else:
        rank = df.select(F.col(id).alias("id"), F.struct(order.alias("a"), F.col(id).alias("b")).alias("rank"))
    rank = checkpoint(valid.join(rank, "id"))
    other = pairs.where("q_id <> r_id").join(rank.select(F.col("id").alias("q_id"), F.col("rank").alias("_q")), "q_id").join(rank.select(F.col("id").alias("r_id"), F.col("rank").alias("_r")), "r_id")
    other = checkpoint(other.select("q_id", "r_id", (F.col("_r") < F.col("_q")).alias("earlier")))
    earlier = other.where("earlier").select("q_id", "r_id")
    if seeds is None:
        seed_votes = None
    else:
        later = other.where("not earlier").join(seeded.withColumnRenamed("id", "r_id"), "r_id").select("q_id", "r_id", "label")
        seed_votes = checkpoint(later.unionByName(seeded.select(F.col("id").alias("q_id"), F.col("id").alias("r_id"), "label")))
    open_nodes, open_edges = rank.select("id"), earlier
    labels: DataFrame | None = None
    while True:
        ready = checkpoint(open_nodes.join(open_edges.select(F.col("q_id").alias("id")).distinct(), "id", "left_anti"))
        asked = ready.select(F.col("id").alias("q_id"))
        votes = None
        if labels is not None:
            votes = earlier.join(asked, "q_id", "left_semi").join(labels.where("label <> -1").select(F.col("id").alias("r_id"), "label"), "r_id").select("q_id", "r_id", "label")
        if seed_votes is not None:
            mine = seed_votes.join(asked, "q_id", "left_semi").select("q_id", "r_id", "label")
            votes = mine if votes is None else votes.unionByName(mine)
        # New clusters are named by their first row, below -1, until the end.
        new = (F.lit(-2).cast("bigint") - F.col("q_id")) if auto_set else F.lit(-1).cast("bigint")
        if votes is None:
            got = asked.select(F.col("q_id").alias("id"), new.alias("label"))
        else:
            got = asked.join(vote(votes), "q_id", "left").select(F.col("q_id").alias("id"), F.coalesce("label", new).alias("label"))
        then = checkpoint(got if labels is None else labels.unionByName(got))
        drop_checkpoint(labels)
        labels = then
        open_nodes = checkpoint(open_nodes.join(ready, "id", "left_anti"))
        if not open_nodes.take(1):
            break
        open_edges = checkpoint(open_edges.join(open_nodes.select(F.col("id").alias("r_id")), "r_id", "left_semi").join(open_nodes.select(F.col("id").alias("q_id")), "q_id", "left_semi").select("q_id", "r_id"))
    return _number_started(labels, rank, id, top)


def clustering(df: DataFrame, axes: Sequence[str], r: float, get_class: Callable[[list], int], id: str = "id", order: Column | None = None, seeds: DataFrame | None = None, auto_set: bool = True) -> DataFrame:
    """Labels by a function of the labels within r, in order: id, label.

    Like ``majority_clusters``, with ``get_class`` in place of the majority: it
    gets the labels other than -1 within r of a row, as a list sorted by the
    rows' ids, and returns one of them or -1; a row without any starts a cluster
    (if ``auto_set``). The function is called once per row; a row's list is as
    long as its neighbourhood. Labels of started clusters are below -1 until the
    end.
    """

    @F.pandas_udf("bigint")
    def pick(labels: pd.Series) -> pd.Series:
        return pd.Series([int(get_class(list(v))) for v in labels], dtype="int64")

    def vote(votes: DataFrame) -> DataFrame:
        lists = votes.groupBy("q_id").agg(F.sort_array(F.collect_list(F.struct("r_id", "label"))).alias("_l"))
        return lists.select("q_id", pick(F.col("_l.label")).alias("label"))

    return _walk_clusters(df, axes, r, vote, _walk_function(get_class), id, order, seeds, auto_set)


def weight_clusters(df: DataFrame, axes: Sequence[str], r: float, seeds: DataFrame, id: str = "id", weights: str | None = None, order: str | None = None) -> DataFrame:
    """Labels by the largest weight of the labels within r, with weights that change on the way: id, label.

    A weight belongs to a label (at the start, to the row of that id) and is
    shared by all its rows, so the walk is sequential. Parts that no pair within
    r and no common label connect are independent; each is walked by one task,
    from its coordinates. Every seed label other than -1 is the id of some row.
    """
    at = [str(i) for i in range(len(axes))]
    weighed = df.withColumns({"_w": F.col(weights).cast("double") if weights else F.lit(1.0), "_o": F.col(order) if order else F.lit(None).cast("bigint")})
    rows = checkpoint(joins.points(weighed, axes, id, "", ["_w", "_o"]).join(seeds.select(F.col(id).alias("id"), "label"), "id"))

    def shared(celled: DataFrame) -> DataFrame:
        """Cells of a row and of the row that its label names."""
        named = celled.where("label <> id and label <> -1").select("label", F.col("_cell").alias("a")).distinct()
        return named.join(celled.select(F.col("id").alias("label"), F.col("_cell").alias("b")), "label").select("a", "b").distinct()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        near = walks.Near(group[at].to_numpy(float), float(r))
        ids, named, weight = group["id"].to_numpy(), group["label"].to_numpy(), group["_w"].to_numpy(float).copy()
        # A label is the place of the row that it names.
        label = np.searchsorted(ids, named)
        label[named == -1] = -1
        if (ids[np.minimum(label, len(ids) - 1)] != named)[label >= 0].any():
            raise ValueError("a seed label is not the id of a row")
        steps = group.sort_values(["_o", "id"]).index.to_numpy() if order else np.lexsort((-ids, -near.count()))
        for i in steps.tolist():
            seen = label[near.points(near.of[i])]
            seen = seen[seen >= 0]
            if not len(seen):
                continue
            found, first, code = np.unique(seen, return_index=True, return_inverse=True)
            total = np.bincount(code, weight[seen])
            # The last label seen, unless others weigh more; of those the heaviest that was seen first.
            best = code[-1]
            heavy = np.flatnonzero(total == total.max())
            if len(heavy) and total[best] < total[heavy[0]]:
                best = heavy[np.argmin(first[heavy])]
            weight[found[best]] = total[best] / len(seen)
            label[i] = found[best]
        return pd.DataFrame({"id": ids, "label": np.where(label >= 0, ids[label], -1)})

    got = walks.by_parts(checkpoint(walks.in_parts(rows, at, r, shared)), run, f"id {rows.schema['id'].dataType.simpleString()}, label bigint")
    return got.select(F.col("id").alias(id), "label")


def class_dict(df: DataFrame, id: str = "id", label: str = "label", min_size: int = 1, max_size: int | None = None, missing: int = -1) -> DataFrame:
    """Sorted ids by label: label, ids; labels of other sizes and the missing one are left out."""
    grouped = df.where(F.col(label) != missing).groupBy(F.col(label).alias("label")).agg(F.sort_array(F.collect_list(id)).alias("ids"))
    size = F.size("ids")
    return grouped.where((size >= min_size) & (size <= max_size if max_size is not None else F.lit(True)))


def class_sizes(df: DataFrame, label: str = "label", min_size: int = 1, max_size: int | None = None, missing: int = -1) -> DataFrame:
    """Rows by label, without lists of ids."""
    grouped = df.where(F.col(label) != missing).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.where((F.col("n") >= min_size) & (F.col("n") <= max_size if max_size is not None else F.lit(True)))


def dict_classes(classes: DataFrame, n: int, missing: int = -1, min_size: int = 1, max_size: int | None = None) -> DataFrame:
    """The inverse of ``class_dict`` for ids 0 to n - 1: id, label, ``missing`` where no label has the id."""
    size = F.size("ids")
    kept = classes.where((size >= min_size) & (size <= max_size if max_size is not None else F.lit(True)))
    flat = kept.select("label", F.explode("ids").alias("id"))
    return classes.sparkSession.range(n).join(flat, "id", "left").select("id", F.coalesce("label", F.lit(missing)).alias("label"))


def split_by_breaks(value: Column, breaks: Sequence[float]) -> Column:
    """Number of breaks at or below a value."""
    total = F.lit(0)
    for b in breaks:
        total = total + (value >= float(b)).cast("int")
    return total


def rename_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Labels replaced by their position among the labels that occur."""
    return df.join(numbered(df, label, "_number"), label).withColumn(label, F.col("_number")).drop("_number")
