"""Spatial joins: radius, box, cube, shell, nearest neighbours and matchers.

Sides are tables with an id and one column per axis. A radius join puts the
reference rows into cells twice the radius wide, repeats each query row for the
cells its box touches (at most two along an axis) and joins on the cell, so
there is no nested loop; the exact distance is tested within the join. Rows of
null or NaN coordinates match nothing. Relations are sets: no order is kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.distance import sdist
from fieldloom.operators.frame import Extent
from fieldloom.session import checkpoint, sized_join

#: Reference rows at one position above which only those of smallest id stay in nearest-neighbour joins.
CROWD = 64
#: Reference rows of one cell above which the cell is joined by salts.
HOT = 5000


def points(df: DataFrame, axes: Sequence[str], id: str = "id", prefix: str = "", extra: Sequence[str] = ()) -> DataFrame:
    """Id and axes as ``{prefix}id``, ``{prefix}0``, ..., without rows of missing coordinates."""
    for a in axes:
        df = df.where(F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double")))
    return df.select(F.col(id).alias(f"{prefix}id"), *(F.col(a).cast("double").alias(f"{prefix}{i}") for i, a in enumerate(axes)), *(F.col(e).alias(prefix + e) for e in extra))


def _cell_join(q: DataFrame, r: DataFrame, dim: int, reach: Column, edge: Sequence[float | Column], condition: Column, skew: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Rows of q (q_0...) and r (r_0...) whose cells the box of ``reach`` around q touches, under ``condition``; ``by`` are further keys."""
    cells = [f"_c{i}" for i in range(dim)]
    home = r.withColumns({c: F.floor(F.col(f"r_{i}") / edge[i]).cast("bigint") for i, c in enumerate(cells)})
    spread = q
    for i, c in enumerate(cells):
        low, high = F.floor((F.col(f"q_{i}") - reach) / edge[i]).cast("bigint"), F.floor((F.col(f"q_{i}") + reach) / edge[i]).cast("bigint")
        spread = spread.withColumn(c, F.explode(F.sequence(low, high)))
    return _meet(spread, home, [*by, *cells], condition, "q_id", skew)


def _meet(spread: DataFrame, home: DataFrame, keys: list[str], condition: Column, by: str, skew: bool = True) -> DataFrame:
    """Equi-join on cells; cells of more than ``HOT`` reference rows are met by salts."""
    if skew:
        hot = checkpoint(home.groupBy(*keys).count().where(F.col("count") > HOT).select(*keys, F.ceil(F.col("count") / HOT).cast("int").alias("_n")))
        skew = bool(hot.take(1))
    if skew:
        one = F.coalesce(F.col("_n"), F.lit(1))
        home = sized_join(home, hot, keys, "left", salt_by="r_id").withColumn("_salt", F.pmod(F.xxhash64("r_id"), one).cast("int")).drop("_n")
        spread = sized_join(spread, hot, keys, "left", salt_by=by).withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_n")
        return spread.join(home, [*keys, "_salt"]).where(condition).drop(*keys, "_salt")
    return spread.join(home, keys).where(condition).drop(*keys)


def _square(dim: int) -> Column:
    return sdist([f"q_{i}" for i in range(dim)], [f"r_{i}" for i in range(dim)])


def ball(queries: DataFrame, refs: DataFrame, axes: Sequence[str], r: float | str, id: str = "id", ref_id: str | None = None, edge: float | None = None, skew: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """All pairs at most ``r`` apart: q_id, r_id, sd (squared distance).

    ``r`` is a number, or the name of a column of ``queries`` with a radius per
    row (negative or null: no neighbours). A self-join contains each row itself.
    Columns in ``carry`` come out of both sides as q_... and r_....
    """
    dim = len(axes)
    refs = points(refs, axes, ref_id or id, "r_", carry)
    out = ["q_id", "r_id", _square(dim).alias("sd"), *(f"{side}_{c}" for c in carry for side in "qr")]
    if isinstance(r, str):
        # Cells fit the radius of each query to a power of two; the reference rows are repeated for the powers that occur.
        q = points(queries, axes, id, "q_", [r, *(c for c in carry if c != r)]).where(F.col("q_" + r) >= 0)
        q = q.withColumn("_size", F.when(F.col("q_" + r) > 2.0**-40, F.ceil(F.log2("q_" + r))).otherwise(F.lit(-40)).cast("int"))
        sizes = sorted(row["_size"] for row in q.select("_size").distinct().collect())
        home = refs.withColumn("_size", F.explode(F.array(*(F.lit(v) for v in sizes)).cast("array<int>")))
        width = F.pow(F.lit(2.0), F.col("_size") + 1)
        return _cell_join(q, home, dim, F.col("q_" + r), [width] * dim, _square(dim) <= F.col("q_" + r) * F.col("q_" + r), skew, ["_size"]).select(*out)
    if r < 0:
        raise ValueError("negative radius")
    edge = edge or (2 * r if r > 0 else 1.0)
    return _cell_join(points(queries, axes, id, "q_", carry), refs, dim, F.lit(float(r)), [edge] * dim, _square(dim) <= float(r) * float(r), skew).select(*out)


def ball_count(queries: DataFrame, refs: DataFrame, axes: Sequence[str], r: float | str, id: str = "id", ref_id: str | None = None) -> DataFrame:
    """Number of reference rows within ``r`` of each query row, 0 included: q_id, n. Rows of missing coordinates have 0."""
    counted = ball(queries, refs, axes, r, id, ref_id).groupBy("q_id").agg(F.count(F.lit(1)).alias("n"))
    every = queries.select(F.col(id).alias("q_id"))
    return every.join(counted, "q_id", "left").select("q_id", F.coalesce("n", F.lit(0)).alias("n"))


def shell(queries: DataFrame, refs: DataFrame, axes: Sequence[str], r_min: float, r_max: float, id: str = "id", ref_id: str | None = None, compat: bool = False) -> DataFrame:
    """Pairs with r_min < d <= r_max; with ``compat`` the pairs within r_min instead."""
    if compat:
        return ball(queries, refs, axes, r_min, id, ref_id)
    return ball(queries, refs, axes, r_max, id, ref_id).where(F.col("sd") > r_min * r_min)


def ellipsoid(queries: DataFrame, refs: DataFrame, axes: Sequence[str], radii: Sequence[float], id: str = "id", ref_id: str | None = None) -> DataFrame:
    """Pairs within an ellipsoid of the given radii; ``sd`` is measured in radii."""
    scale = lambda df: df.withColumns({a: F.col(a) / r for a, r in zip(axes, radii, strict=True)})
    return ball(scale(queries), scale(refs), axes, 1.0, id, ref_id)


def cube(queries: DataFrame, refs: DataFrame, axes: Sequence[str], r: float, id: str = "id", ref_id: str | None = None) -> DataFrame:
    """Pairs at most ``r`` apart along every axis: q_id, r_id."""
    dim = len(axes)
    apart = [F.abs(F.col(f"q_{i}") - F.col(f"r_{i}")) for i in range(dim)]
    far = F.greatest(*apart) if dim > 1 else apart[0]
    pairs = _cell_join(points(queries, axes, id, "q_"), points(refs, axes, ref_id or id, "r_"), dim, F.lit(float(r)), [2 * r if r > 0 else 1.0] * dim, far <= r, True)
    return pairs.select("q_id", "r_id")


def box(df: DataFrame, axes: Sequence[str], extent: Extent) -> DataFrame:
    """Rows in a closed box; the comparison reaches the file scan."""
    return df.where(extent.contains(axes))


def box_count(df: DataFrame, axes: Sequence[str], extent: Extent) -> int:
    return box(df, axes, extent).count()


def boxes(df: DataFrame, extents: DataFrame, axes: Sequence[str], edge: float, id: str = "id") -> DataFrame:
    """Rows in many closed boxes (box_id, low_0.., high_0..): box_id, id. Cells of ``edge`` bring them together."""
    cells = [f"_c{i}" for i in range(len(axes))]
    home = points(df, axes, id, "r_").withColumns({c: F.floor(F.col(f"r_{i}") / edge).cast("bigint") for i, c in enumerate(cells)})
    spread = extents
    test = F.lit(True)
    for i, c in enumerate(cells):
        spread = spread.withColumn(c, F.explode(F.sequence(F.floor(F.col(f"low_{i}") / edge).cast("bigint"), F.floor(F.col(f"high_{i}") / edge).cast("bigint"))))
        test = test & F.col(f"r_{i}").between(F.col(f"low_{i}"), F.col(f"high_{i}"))
    return _meet(spread, home, cells, test, "box_id").select("box_id", F.col("r_id").alias(id))


def slice_axis(df: DataFrame, axis: str, low: float = float("-inf"), high: float = float("inf")) -> DataFrame:
    """Rows whose value on one axis lies in the closed range."""
    return df.where(F.col(axis).between(low, high))


def knn(
    queries: DataFrame, refs: DataFrame, axes: Sequence[str], k: int | str = 1, id: str = "id", ref_id: str | None = None, exclude_self: bool = False, within: float | None = None, start: float | None = None
) -> DataFrame:
    """The k nearest reference rows of every query row: q_id, r_id, sd, rank (from 1).

    Ties go to the smaller id. ``k`` is a number or a column of ``queries``.
    ``within`` keeps distances strictly below it. ``exclude_self`` leaves out
    the reference of the same id. Queries are answered in rounds of doubling
    radius, starting from what the density suggests: a query is finished when
    its k-th neighbour lies within the radius. With fewer than k references,
    all of them are returned. Of a position with many references only those that
    ties can choose take part, so repeated rows do not multiply.
    """
    dim = len(axes)
    most = F.col("q_" + k) if isinstance(k, str) else F.lit(k)
    extra = [k] if isinstance(k, str) else []
    q = checkpoint(points(queries, axes, id, "q_", extra))
    r = checkpoint(points(refs, axes, ref_id or id, "r_"))
    stats = [Extent.of(q, [f"q_{i}" for i in range(dim)]), Extent.of(r, [f"r_{i}" for i in range(dim)])]
    spark = queries.sparkSession
    schema = f"q_id {q.schema['q_id'].dataType.simpleString()}, r_id {r.schema['r_id'].dataType.simpleString()}, sd double, rank int"
    if None in stats:
        return spark.createDataFrame([], schema)
    low = [min(s.low[i] for s in stats) for i in range(dim)]
    high = [max(s.high[i] for s in stats) for i in range(dim)]
    whole = sum((h - lo) ** 2 for lo, h in zip(low, high)) ** 0.5 * 1.0001 + 1e-9
    limit = min(whole, within) if within is not None else whole
    count = r.count()
    number = q.agg(F.max(most).alias("m")).first()["m"] or 1
    r = _thin_positions(r, dim, number + 1)
    if start is None:
        start = _usual_distance(r, dim, number + 1, count)
    radius = min(max(start, limit * 1e-6), limit)
    done: DataFrame | None = None
    open_q = q
    while True:
        other = _square(dim) <= radius * radius
        if exclude_self:
            other = other & (F.col("q_id") != F.col("r_id"))
        if within is not None:
            other = other & (_square(dim) < within * within)
        pairs = _cell_join(open_q, r, dim, F.lit(float(radius)), [2 * radius] * dim, other, True)
        window = Window.partitionBy("q_id").orderBy("sd", "r_id")
        ranked = pairs.select("q_id", "r_id", _square(dim).alias("sd"), most.alias("_k")).withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= F.col("_k"))
        found = checkpoint(ranked.select("q_id", "r_id", "sd", "rank"))
        last = radius >= limit
        if last:
            return found if done is None else done.unionByName(found)
        full = found.groupBy("q_id").agg(F.count(F.lit(1)).alias("_n"))
        left = checkpoint(open_q.join(full, "q_id", "left").where(F.coalesce("_n", F.lit(0)) < most).drop("_n"))
        closed = found.join(left.select("q_id"), "q_id", "left_anti")
        done = closed if done is None else done.unionByName(closed)
        if not left.take(1):
            return done
        open_q = left
        radius = min(2 * radius, limit)


def _usual_distance(r: DataFrame, dim: int, k: int, count: int) -> float:
    """A radius that holds about k rows where rows are, from the cells that are occupied.

    The middle nine tenths of each axis give a first edge, so that strays do not
    count; of edges around it the smallest is taken whose occupied cells hold,
    besides one, about a third of k rows. Two aggregates.
    """
    share = [0.05, 0.95]
    row = r.agg(*(F.percentile_approx(f"r_{i}", share, 1000).alias(f"p{i}") for i in range(dim))).first()
    volume = 1.0
    for i in range(dim):
        volume *= max(row[f"p{i}"][1] - row[f"p{i}"][0], 1e-9)
    edge = (volume * k / count) ** (1 / dim)
    edges = [edge * 2.0**j for j in range(-8, 4)]
    cells = r.agg(*(F.approx_count_distinct(F.xxhash64(*(F.floor(F.col(f"r_{i}") / e) for i in range(dim)))).alias(f"c{j}") for j, e in enumerate(edges))).first()
    return next((e for j, e in enumerate(edges) if 3 * (count - cells[f"c{j}"]) >= k * cells[f"c{j}"]), edges[-1])


def _thin_positions(r: DataFrame, dim: int, keep: int) -> DataFrame:
    """The rows that can be among the nearest: of a crowded position, the ``keep`` smallest ids.

    Rows at one position are equally far from any query and ties go to the
    smaller id, so no others are ever asked for (one more than k, as a query may
    be one of them). They are ranked in shares first.
    """
    at = [f"r_{i}" for i in range(dim)]
    most = max(CROWD, keep)
    crowded = r.groupBy(*at).count().where(F.col("count") > most).select(*at, F.lit(True).alias("_crowd"))
    if not crowded.take(1):
        return r
    marked = sized_join(r, checkpoint(crowded), at, "left", salt_by="r_id")
    shares = marked.where("_crowd").withColumn("_share", F.pmod(F.xxhash64("r_id"), F.lit(64)))
    for keys in ([*at, "_share"], at):
        shares = shares.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("r_id"))).where(F.col("_i") <= keep)
    return checkpoint(marked.where("_crowd is null").select(*r.columns).unionByName(shares.select(*r.columns)))


def nearest_other(df: DataFrame, axes: Sequence[str], id: str = "id", ids: DataFrame | None = None) -> DataFrame:
    """Nearest other row of every row, or of the rows in ``ids``: q_id, r_id, sd."""
    asked = df if ids is None else df.join(ids.select(id).distinct(), id, "left_semi")
    return knn(asked, df, axes, 1, id, exclude_self=True).drop("rank")


def _scaled(df: DataFrame, axes: Sequence[str], radii: Sequence[float]) -> DataFrame:
    return df.withColumns({a: F.col(a) / r for a, r in zip(axes, radii, strict=True)})


def match_sphere(a: DataFrame, b: DataFrame, axes: Sequence[str], radii: Sequence[float], id: str = "id") -> DataFrame:
    """All pairs within the ellipsoid: a_id, b_id, sd in radii."""
    return ball(_scaled(b, axes, radii), _scaled(a, axes, radii), axes, 1.0, id).select(F.col("r_id").alias("a_id"), F.col("q_id").alias("b_id"), "sd")


def match_knn(a: DataFrame, b: DataFrame, axes: Sequence[str], radii: Sequence[float], k: int = 1, id: str = "id") -> DataFrame:
    """For each row of b its k nearest rows of a strictly within the ellipsoid."""
    return knn(_scaled(b, axes, radii), _scaled(a, axes, radii), axes, k, id, within=1.0).select(F.col("r_id").alias("a_id"), F.col("q_id").alias("b_id"), "sd")


def match_pair(a: DataFrame, b: DataFrame, axes: Sequence[str], radii: Sequence[float], id: str = "id") -> DataFrame:
    """Pairs that are each other's nearest, strictly within the ellipsoid."""
    there = match_knn(a, b, axes, radii, 1, id)
    back = match_knn(b, a, axes, radii, 1, id).select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"))
    return there.join(back, ["a_id", "b_id"], "left_semi")
