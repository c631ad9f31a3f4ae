"""Filling containers of fixed capacity by harmonic classes.

An item of length L belongs to class k if capacity / (k + 1) < L <= capacity / k,
so that any k items of the class fill one container. Documents are dealt to
shares by a hash; within a share every class numbers its items, longest first,
and each k of them become a container, independently of other classes and
shares. This is done by window functions in one shuffle.

Pure harmonic packing leaves a sixth of the space unused. So in each share the
first classes are fixed, as many as leave gaps that the items of the later
classes can fill; these, and the items that no whole container of their class
took, then fill the gaps, and only what is left over is packed jointly, longest
first. A text longer than the capacity is cut into full containers and one
remainder, which is packed like other items.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents that one worker packs together, on average.
SHARE = 20000
#: Container kinds with their capacities; the table is small and its size is checked.
KINDS = 1000


class _Shelf:
    """Items by length, of which the longest up to a limit is taken."""

    def __init__(self, lengths: Sequence[int], capacity: int) -> None:
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        for i in range(len(lengths) - 1, -1, -1):
            self.stacks[lengths[i]].append(i)
        # below[l]: a length up to l above which no shorter one has items; links are shortened as they are followed.
        self.below = list(range(capacity + 1))

    def longest(self, limit: int) -> int:
        """Largest length up to ``limit`` that still has items, or 0."""
        below, at = self.below, limit
        while at and not (below[at] == at and self.stacks[at]):
            below[at] = at - 1 if below[at] == at else below[at]
            at = below[at]
        while limit != at:
            below[limit], limit = at, below[limit]
        return at

    def fill(self, out: np.ndarray, container: int, left: int) -> None:
        """Put the longest items that fit into a container with ``left`` space."""
        while left and (length := self.longest(left)):
            out[self.stacks[length].pop()] = container
            left -= length


def pack(gaps: Sequence[int], lengths: Sequence[int], capacity: int) -> np.ndarray:
    """Container of each item: the gaps have numbers 0 to n - 1 and are filled first, the widest first; then new ones follow.

    Lengths are from 1 to ``capacity``.
    """
    shelf, out = _Shelf(lengths, capacity), np.full(len(lengths), -1, np.int64)
    for i in np.argsort(-np.asarray(gaps, np.int64), kind="stable"):
        shelf.fill(out, int(i), int(gaps[i]))
    container = len(gaps)
    while shelf.longest(capacity):
        shelf.fill(out, container, capacity)
        container += 1
    return out


def classed(rest: DataFrame) -> DataFrame:
    """Harmonic classes within shares, for items (container_kind, capacity_tokens, _share, doc_id, tokens).

    Adds ``class`` (k), ``_bin`` (number of the class's container in the share),
    ``_whole`` (the container has all its k items) and ``_fixed`` (it stays).
    """
    keys = ["container_kind", "capacity_tokens", "_share"]
    k = F.floor(F.col("capacity_tokens") / F.col("tokens")).cast("bigint")
    # One shuffle: the windows and the packing after them use the same partitioning.
    items = rest.repartition(*keys).withColumn("class", k)
    place = F.row_number().over(Window.partitionBy(*keys, "class").orderBy(F.desc("tokens"), "doc_id", "piece")) - 1
    number = F.count(F.lit(1)).over(Window.partitionBy(*keys, "class"))
    items = items.withColumns({"_bin": F.floor(place / F.col("class")).cast("bigint"), "_of": number})
    items = items.withColumn("_whole", (F.col("_bin") + 1) * F.col("class") <= F.col("_of"))
    gap = F.when(F.col("_whole"), F.col("capacity_tokens") / F.col("class") - F.col("tokens")).otherwise(F.lit(0.0))
    so_far = Window.partitionBy(*keys).orderBy("class").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    items = items.withColumns({"_gaps": F.sum(gap).over(so_far), "_later": F.sum("tokens").over(Window.partitionBy(*keys)) - F.sum("tokens").over(so_far)})
    return items.withColumn("_fixed", F.col("_whole") & (F.col("_gaps") <= F.col("_later"))).drop("_of", "_gaps", "_later")


def packed(sizes: DataFrame, containers: DataFrame, id: str = "doc_id", share: int = SHARE) -> DataFrame:
    """Every document's pieces with their containers, for each kind of container.

    Returns container_kind, capacity_tokens, doc_id, piece, start_token, tokens,
    class (the number of items of its length that fill a container),
    class_container (its container by classes alone, with the number of its
    items in ``class_items``), fixed (the container takes its items of that
    class as they are) and container_id. Documents of no tokens come out with one piece of 0 tokens
    and a null container, and so do those of a container kind whose capacity is
    null or not positive, with piece 0 and all their tokens. Repeated ids are
    packed as documents of their own.
    """
    kinds = containers.select("container_kind", F.col("capacity_tokens").cast("bigint").alias("capacity_tokens")).limit(KINDS + 1).collect()
    if len(kinds) > KINDS:
        raise ValueError(f"more than {KINDS} kinds of containers")
    shares = max(1, -(-sizes.count() // share))
    # A bounded list, so every document is repeated for each kind without a join.
    listed = F.array(*(F.struct(F.lit(k["container_kind"]).cast("string").alias("container_kind"), F.lit(k["capacity_tokens"]).cast("bigint").alias("capacity_tokens")) for k in kinds))
    if not kinds:
        listed = F.lit(None).cast("array<struct<container_kind:string,capacity_tokens:bigint>>")
    each = sizes.select(F.col(id).alias("doc_id"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("_n"), F.explode(listed).alias("_k")).select("doc_id", "_n", "_k.*")
    usable = (F.col("_n") > 0) & (F.coalesce("capacity_tokens", F.lit(0)) > 0)
    whole = F.when(usable, F.floor(F.col("_n") / F.col("capacity_tokens"))).otherwise(F.lit(0)).cast("bigint")
    each = each.withColumn("_full", whole)
    names = ["container_kind", "capacity_tokens", "doc_id", "piece", "start_token", "tokens", "class", "class_container", "class_items", "fixed", "container_id"]
    full = each.where("_full > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_full") - 1))).withColumn("_row", F.monotonically_increasing_id())
    name = F.concat_ws("-", "container_kind", F.lit("w"), F.col("_row").cast("string"))
    full = full.select("container_kind", "capacity_tokens", "doc_id", "piece", (F.col("piece") * F.col("capacity_tokens")).alias("start_token"), F.col("capacity_tokens").alias("tokens"), F.lit(1).cast("bigint").alias("class"), name.alias("class_container"), F.lit(1).cast("bigint").alias("class_items"), F.lit(True).alias("fixed"), name.alias("container_id"))
    none = lambda kind: F.lit(None).cast(kind)
    empty = each.where(~usable).select("container_kind", "capacity_tokens", "doc_id", F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("start_token"), F.col("_n").alias("tokens"), none("bigint").alias("class"), none("string").alias("class_container"), none("bigint").alias("class_items"), none("boolean").alias("fixed"), none("string").alias("container_id"))
    rest = each.where(usable & (F.col("_n") > F.col("_full") * F.col("capacity_tokens")))
    rest = rest.select("container_kind", "capacity_tokens", "doc_id", F.col("_full").alias("piece"), (F.col("_full") * F.col("capacity_tokens")).alias("start_token"), (F.col("_n") - F.col("_full") * F.col("capacity_tokens")).alias("tokens"), F.pmod(F.xxhash64("doc_id"), F.lit(shares)).alias("_share"))

    items = classed(rest)
    in_bin = Window.partitionBy("container_kind", "capacity_tokens", "_share", "class", "_bin")
    items = items.withColumns({"class_container": F.concat_ws("-", "container_kind", F.lit("c"), "_share", "class", "_bin"), "class_items": F.count(F.lit(1)).over(in_bin)})

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        capacity, fixed = int(group["capacity_tokens"].iloc[0]), group["_fixed"].to_numpy(bool)
        hosts = group[fixed]
        number, _ = hosts["class_container"].factorize()
        load = np.bincount(number, hosts["tokens"]).astype(np.int64) if len(hosts) else np.zeros(0, np.int64)
        at = np.zeros(len(group), np.int64)
        at[fixed] = number
        at[~fixed] = pack(capacity - load, group["tokens"][~fixed].tolist(), capacity)
        name = f"{group['container_kind'].iloc[0]}-{group['_share'].iloc[0]}-"
        return group.assign(container_id=[name + str(i) for i in at], fixed=fixed)[names]

    schema = "container_kind string, capacity_tokens bigint, doc_id bigint, piece bigint, start_token bigint, tokens bigint, class bigint, class_container string, class_items bigint, fixed boolean, container_id string"
    filled = items.groupBy("container_kind", "capacity_tokens", "_share").applyInPandas(fill, schema)
    return full.select(*names).unionByName(filled).unionByName(empty.select(*names))


def packing_report(rows: DataFrame) -> DataFrame:
    """Containers, items, tokens and the share of space that is filled, by kind.

    ``filled_by_classes`` is the share that harmonic classes alone would fill,
    ``fixed_items`` the number of items that stay in containers of their class.
    """
    held = rows.where("container_id is not null")
    kind = ["container_kind", "capacity_tokens"]
    each = held.groupBy(*kind, "container_id").agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"), F.count_if("fixed").alias("fixed_items"), F.sum(1 / F.col("class_items")).alias("_own"))
    total = each.groupBy(*kind).agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("fixed_items").alias("fixed_items"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.min("tokens").alias("emptiest"), F.round(F.sum("_own")).alias("_pure"))
    share = lambda n: F.round(F.col("tokens") / (F.col(n) * F.col("capacity_tokens")), 6)
    return total.withColumns({"filled": share("containers"), "filled_by_classes": share("_pure")}).drop("_pure")


def packing_checks(rows: DataFrame, sizes: DataFrame, id: str = "doc_id") -> DataFrame:
    """Faults by kind, all 0 in a right packing: container_kind, documents, lost, overfull, miscounted.

    lost: documents whose pieces do not follow each other up to their tokens;
    overfull: containers beyond their capacity; miscounted: containers that are
    fixed but do not hold exactly ``class`` fixed items of one class.
    """
    kind = ["container_kind", "capacity_tokens"]
    own = sizes.groupBy(F.col(id).alias("doc_id")).agg(F.sum(F.coalesce("tokens", F.lit(0))).alias("_n"), F.count(F.lit(1)).alias("_copies"))
    docs = rows.groupBy(*kind, "doc_id").agg(F.sum("tokens").alias("_got"), F.max(F.col("start_token") + F.col("tokens")).alias("_end"))
    docs = docs.join(own, "doc_id", "full").groupBy(*kind).agg(F.sum("_copies").alias("documents"), F.count_if(~F.coalesce((F.col("_got") == F.col("_n")) & (F.col("_end") * F.col("_copies") >= F.col("_n")), F.lit(False))).alias("lost"))
    held = rows.where("container_id is not null").groupBy(*kind, "container_id").agg(F.sum("tokens").alias("_load"), F.count_if("fixed").alias("_fixed"), F.min(F.when(F.col("fixed"), F.col("class"))).alias("_low"), F.max(F.when(F.col("fixed"), F.col("class"))).alias("_high"))
    bad = (F.col("_fixed") > 0) & ((F.col("_low") != F.col("_high")) | (F.col("_fixed") != F.col("_low")))
    held = held.groupBy(*kind).agg(F.count_if(F.col("_load") > F.col("capacity_tokens")).alias("overfull"), F.count_if(bad).alias("miscounted"))
    return docs.join(held, kind, "left").select("container_kind", "documents", "lost", F.coalesce("overfull", F.lit(0)).alias("overfull"), F.coalesce("miscounted", F.lit(0)).alias("miscounted"))
