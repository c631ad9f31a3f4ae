"""Mixing sources to target shares by Pareto order sampling.

Of each source with documents the mixture needs a number of tokens; divided by
what it has, that is the expected number of copies of its documents. The whole
part of it is allocated to every document. The rest is a sample without
replacement: each document has a probability of inclusion, a uniform random
number from a hash of its id, and the ratio of their odds; the documents of
smallest ratio are taken until the tokens are reached. The order statistic at
which they are reached is found by a histogram of the ratios and an exact order
within one bin, so that no source is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.session import checkpoint

#: Bins of the histogram of odds ratios.
BINS = 8192
#: Rows the table of targets may have.
TARGETS = 10000
#: Probabilities of inclusion grow with this power of a document's tokens.
POWER = 0.5


def needs(totals: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """Per source: wanted tokens, whole copies and the sampled rest.

    The shares of sources that have tokens are rescaled to sum to 1. Without
    ``total_tokens`` the mixture is the largest in which every source has its
    share within its ``max_repeats``; with it, a source gives at most what its
    repeats allow. Null or negative shares count as 0, null repeats as 1.
    """
    if targets.count() > TARGETS:
        raise ValueError(f"more than {TARGETS} targets")
    one = targets.groupBy("source").agg(F.greatest(F.coalesce(F.sum("target_share"), F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats"))
    known = one.join(totals, "source", "left").select("source", "target_share", "max_repeats", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("docs", "have", "weight")))
    live = (F.col("have") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    every = Window.partitionBy()
    known = known.withColumn("share", F.when(live, F.col("target_share") / F.sum(F.when(live, F.col("target_share"))).over(every)).otherwise(F.lit(0.0)))
    most = F.min(F.when(live, F.col("max_repeats") * F.col("have") / F.col("share"))).over(every)
    goal = F.lit(float(total_tokens)) if total_tokens is not None else most
    known = known.withColumn("want", F.when(live, F.least(F.col("share") * goal, (F.col("max_repeats") * F.col("have")).cast("double"))).otherwise(F.lit(0.0)))
    copies = F.when(live, F.col("want") / F.col("have")).otherwise(F.lit(0.0))
    # A rest below a millionth of the source is rounding, not a sample.
    known = known.withColumn("whole", F.floor(copies + 1e-6).cast("int"))
    return known.withColumn("part", F.when(copies - F.col("whole") > 1e-6, copies - F.col("whole")).otherwise(F.lit(0.0)))


def mixed(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 7) -> DataFrame:
    """The documents of the mixture: doc_id, source, tokens, copies (at least 1).

    ``sizes`` has doc_id, source and tokens. Documents of null or unlisted
    sources and of no tokens are not part of a mixture. Repeated ids are drawn
    together. An empty table gives an empty result.
    """
    docs = sizes.where("source is not null and tokens > 0").select("doc_id", "source", "tokens").withColumn("_w", F.pow("tokens", F.lit(POWER)))
    docs = checkpoint(docs)
    totals = docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("have"), F.sum(F.col("_w") * F.col("tokens")).alias("weight"))
    plan = checkpoint(needs(totals, targets, total_tokens))
    rows = docs.join(F.broadcast(plan.select("source", "have", "weight", "whole", "part")), "source")
    # Expected sampled tokens are part * have when the probability is c * w with this c.
    chance = F.least(F.col("part") * F.col("have") / F.col("weight") * F.col("_w"), F.lit(1 - 1e-9))
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    ratio = (uniform / (1 - uniform)) / (chance / (1 - chance))
    rows = rows.withColumn("_q", F.when(F.col("part") > 0, ratio))
    rows = rows.withColumn("_bin", F.when(F.col("_q").isNotNull(), F.least(F.floor(F.col("_q") / (1 + F.col("_q")) * BINS), F.lit(BINS - 1)).cast("int")))
    bins = rows.where("_bin is not null").groupBy("source", "_bin").agg(F.sum("tokens").alias("_t"), F.first(F.col("part") * F.col("have")).alias("_need"))
    run = bins.withColumn("_to", F.sum("_t").over(Window.partitionBy("source").orderBy("_bin")))
    edge = run.where((F.col("_to") >= F.col("_need")) & (F.col("_to") - F.col("_t") < F.col("_need"))).select("source", F.col("_bin").alias("_edge"), (F.col("_need") - F.col("_to") + F.col("_t")).alias("_open"))
    edge = checkpoint(edge)
    rows = rows.join(F.broadcast(edge), "source", "left")
    # Without an edge the need exceeds all tokens by rounding only: everything is taken.
    sure = F.col("_bin").isNotNull() & (F.col("_edge").isNull() | (F.col("_bin") < F.col("_edge")))
    border = rows.where("_bin = _edge")
    order = Window.partitionBy("source").orderBy("_q", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Of the last bin, documents are taken while that brings the sum nearer to the need.
    taken = border.withColumn("_to", F.sum("tokens").over(order)).withColumn("_in", (F.col("_to") - F.col("tokens") / 2 <= F.col("_open")))
    outside = rows.where(F.coalesce(F.col("_bin") != F.col("_edge"), F.lit(True))).withColumn("_in", sure)
    keep = ["doc_id", "source", "tokens", (F.col("whole") + F.col("_in").cast("int")).alias("copies")]
    return outside.select(*keep).unionByName(taken.select(*keep)).where("copies > 0")


def mixture_report(mixture: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share of every listed source, with its documents, tokens and most copies.

    Sources without documents have an actual share of 0.
    """
    got = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    have = sizes.where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    listed = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = listed.join(got, "source", "left").join(have, "source", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "source_tokens", "mixed_tokens", "most_copies")]
    rows = rows.select("source", "target_share", "max_repeats", *zero)
    return rows.withColumn("actual_share", F.round(F.try_divide("mixed_tokens", F.sum("mixed_tokens").over(Window.partitionBy())), 6))


def mixture_checks(mixture: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """For every listed source its rescaled share, and whether the mixture keeps it and its repeats: source, share, kept, unknown.

    kept: no document is repeated beyond ``max_repeats``, and the actual share
    differs from the rescaled one by no more than the longest document of any
    source makes out of all tokens. unknown: rows of the mixture that are no
    document of the source.
    """
    report = mixture_report(mixture, sizes, targets)
    live = F.when((F.col("source_tokens") > 0) & (F.col("max_repeats") > 0), F.col("target_share")).otherwise(F.lit(0.0))
    share = live / F.sum(live).over(Window.partitionBy())
    longest = mixture.agg(F.max("tokens").alias("_m"), F.sum(F.col("tokens") * F.col("copies")).alias("_all"))
    rows = report.withColumn("share", share).join(F.broadcast(longest), F.lit(True), "left")  # one row
    own = sizes.groupBy("doc_id", "source", "tokens").agg(F.count(F.lit(1)).alias("_n"))
    strange = mixture.join(own, ["doc_id", "source", "tokens"], "left").groupBy("source").agg(F.count_if(F.col("_n").isNull()).alias("unknown"))
    kept = (F.col("most_copies") <= F.col("max_repeats")) & (F.abs(F.coalesce("actual_share", F.lit(0.0)) - F.col("share")) <= F.coalesce(F.col("_m") / F.col("_all"), F.lit(0.0)) + 1e-6)
    return rows.join(strange, "source", "left").select("source", F.round("share", 6).alias("share"), kept.alias("kept"), F.coalesce("unknown", F.lit(0)).alias("unknown"))
