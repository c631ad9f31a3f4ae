"""Connected components by contraction, and roots of pointer forests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.session import checkpoint, drop_checkpoint


def resolve_pointers(pointers: DataFrame) -> DataFrame:
    """Replace every parent by the root above it: (node, parent) to (node, parent).

    ``pointers`` has each node once; roots point to themselves, and every parent
    is a node. Each round doubles the length of the path that is followed, so
    the rounds are the logarithm of the depth.
    """
    now = checkpoint(pointers.select("node", "parent"))
    while True:
        above = now.select(F.col("node").alias("_p"), F.col("parent").alias("_pp")).where("_p <> _pp")
        far = now.join(above, now["parent"] == above["_p"], "left").select("node", F.coalesce("_pp", "parent").alias("parent"), F.col("_pp").isNotNull().alias("_moved"))
        then = checkpoint(far)
        drop_checkpoint(now)
        now = then
        if not now.where("_moved").take(1):
            return now.select("node", "parent")


def components(edges: DataFrame) -> DataFrame:
    """Label each node of the undirected edges (a, b) with the smallest node of its component: (node, label).

    In each round every node hooks to its smallest neighbour if that is smaller,
    the trees are resolved, and the edges are taken between the roots. At most
    half of the nodes of a component stay roots, so few rounds are needed and
    the edges shrink with each. Loops, repeated edges and nulls do no harm; an
    empty table gives an empty result.
    """
    open_edges = checkpoint(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels: DataFrame | None = None
    while True:
        both = open_edges.unionByName(open_edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m")).select("node", F.least("node", "_m").alias("parent"))
        roots = resolve_pointers(hooks)
        if labels is None:
            labels = checkpoint(roots.select("node", F.col("parent").alias("label")))
        else:
            to = roots.select(F.col("node").alias("label"), "parent")
            then = checkpoint(labels.join(to, "label", "left").select("node", F.coalesce("parent", "label").alias("label")))
            drop_checkpoint(labels)
            labels = then
        a, b = roots.select(F.col("node").alias("a"), F.col("parent").alias("_a")), roots.select(F.col("node").alias("b"), F.col("parent").alias("_b"))
        left = open_edges.join(a, "a").join(b, "b").where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
        then = checkpoint(left)
        drop_checkpoint(open_edges)
        open_edges = then
        if not open_edges.take(1):
            return labels
