"""Bring quantities recorded in different units and systems to common units.

Statements (system names, remarks) are parsed once per record set, joined to
the records by a sized join, and checked against the position of each record.
Where they contradict it, or nothing is stated, the unit is the one of highest
posterior under a mixture on the log scale whose components are offset by the
known conversion factors: one shift and one spread for all, a weight for each
unit, and a flat component for values of no unit. The mixture is fitted to a
histogram of at most ``BINS`` counts, so that one pass with partial aggregation
serves any size. Whether a unit puts a row within reach of its site's centre is
evidence in the same posterior; an exact check of the reach follows it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.projection import DEGREES, UNITS, cached_proj, cached_remark, with_east_north
from fieldloom.session import fence, sized_join

#: Units that a position alone may tell, by metres.
POSITION_UNITS = ("m", "km", "cm", "mm")
BIN = 0.01
REACH = 8.0
BINS = round(2 * REACH / BIN) + 1
#: Chance that a wrong unit puts a row within reach of its centre, or the right one does not.
STRAY = 1e-9
#: Share of a unit's component that is spread over the whole range, for rows far from its middle.
TAIL = 1e-3

STATEMENT = T.StructType([
    T.StructField("p_kind", T.StringType()), T.StructField("p_lon0", T.DoubleType()), T.StructField("p_k0", T.DoubleType()),
    T.StructField("p_x0", T.DoubleType()), T.StructField("p_y0", T.DoubleType()), T.StructField("p_h", T.StringType()),
    T.StructField("p_v", T.StringType()), T.StructField("p_swap", T.BooleanType()), T.StructField("r_h", T.StringType()),
    T.StructField("r_v", T.StringType()), T.StructField("r_strip", T.IntegerType()), T.StructField("r_rest", T.StringType()),
])


@F.pandas_udf(STATEMENT)
def statement(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Parse a system text and a remark into one row of statements; nulls give nulls."""
    names = STATEMENT.fieldNames()
    for proj, remark in batches:
        rows = []
        for p, r in zip(proj, remark):
            p = (cached_proj(p) if isinstance(p, str) else None) or {}
            r = (cached_remark(r) if isinstance(r, str) else None) or {}
            rows.append((p.get("kind"), p.get("lon0"), p.get("k0"), p.get("x0"), p.get("y0"), p.get("h"), p.get("v"), p.get("swap"), r.get("h"), r.get("v"), r.get("strip"), r.get("rest")))
        yield pd.DataFrame(rows, columns=names).astype({"r_strip": "Int32", "p_swap": "boolean"})


def metres(unit: Column) -> Column:
    """Metres (or degrees) per unit, as a lookup over the known names."""
    pairs = [F.lit(v) for item in (UNITS | DEGREES).items() for v in item]
    return F.create_map(*pairs)[unit]


def fit_log_mixture(bins: np.ndarray, counts: np.ndarray, offsets: np.ndarray, rounds: int = 200) -> dict:
    """EM for a mixture on the log scale with components at ``shift + offsets``.

    ``bins`` are bin centres, ``counts`` their rows. The last weight belongs to
    a flat component over the whole range, which takes values of no unit. An
    empty histogram gives equal weights and the start spread.
    """
    n, width = counts.sum(), 2 * REACH
    weights, shift, spread = np.full(len(offsets) + 1, 1 / (len(offsets) + 1)), 0.0, 0.05
    if n == 0:
        return {"weights": weights, "shift": shift, "spread": spread}
    for _ in range(rounds):
        z = (bins[:, None] - offsets[None, :] - shift) / spread
        dens = np.column_stack([np.exp(-0.5 * z * z) / (spread * math.sqrt(2 * math.pi)), np.full(len(bins), 1 / width)]) * weights
        post = dens / np.maximum(dens.sum(axis=1, keepdims=True), 1e-300) * counts[:, None]
        mass = post.sum(axis=0)
        named = post[:, :-1]
        if named.sum() > 0:
            centred = bins[:, None] - offsets[None, :]
            new_shift = float((named * centred).sum() / named.sum())
            new_spread = math.sqrt(max(float((named * (centred - new_shift) ** 2).sum() / named.sum()), (BIN / 2) ** 2))
        else:
            new_shift, new_spread = shift, spread
        new_weights = np.maximum(mass / n, 1e-6)
        new_weights /= new_weights.sum()
        done = abs(new_shift - shift) + abs(new_spread - spread) + np.abs(new_weights - weights).max() < 1e-9
        weights, shift, spread = new_weights, new_shift, new_spread
        if done:
            break
    return {"weights": weights, "shift": shift, "spread": spread}


def _score(u: Column, inside: Column, unit: str, weight: float, fit: dict) -> Column:
    """Weighted likelihood of one unit at log ratio ``u``, given whether it puts the row within reach (null: unknown)."""
    z = (u - F.lit(fit["shift"] - math.log10(UNITS[unit]))) / F.lit(fit["spread"])
    core = F.lit((1 - TAIL) / (fit["spread"] * math.sqrt(2 * math.pi))) * F.exp(-0.5 * z * z) + F.lit(TAIL / (2 * REACH))
    odds = (1 - STRAY) / STRAY
    return F.lit(float(weight)) * core * F.when(inside, F.lit(odds)).when(~inside, F.lit(1 / odds)).otherwise(F.lit(1.0))


def stated_units(records: DataFrame, scans: DataFrame, sites: DataFrame) -> DataFrame:
    """Records with what is stated for them, and the position that follows from it.

    Adds ``h``, ``v`` (stated or default unit names), ``stated``, ``east``,
    ``north``, the raw easting and northing ``raw_e`` and ``raw_n``, the site's
    ``center_x``, ``center_y``, and ``fits``: the position is within ``reach``
    of the centre along both axes (null where there is no position or centre).
    """
    said = scans.select("scan_id", statement("proj", "remark").alias("s")).select("scan_id", "s.*")
    centre = sites.select(F.col("site_id"), "center_x", "center_y")
    core = records.select("rec_id", "scan_id", "site_id", "pt_src_id", "x", "y", "z")
    joined = sized_join(core, said, ["scan_id"], "left", salt_by="rec_id", width=160)
    joined = sized_join(joined, centre, ["site_id"], "left", salt_by="rec_id")
    mine = F.col("r_strip").isNull() | F.coalesce(F.col("pt_src_id") == F.col("r_strip"), F.lit(False))
    remark_h = F.when(F.col("r_h").isNotNull(), F.when(mine, F.col("r_h")).otherwise(F.col("r_rest")))
    remark_v = F.when(F.col("r_v").isNotNull(), F.when(mine, F.col("r_v")).otherwise(F.col("r_rest")))
    degrees = lambda c: c.isin(*DEGREES)
    df = joined.withColumns({"_rh": remark_h, "_rv": remark_v})
    df = df.withColumns({
        "h": F.coalesce("_rh", "p_h", F.lit("m")),
        "v": F.coalesce("_rv", "p_v", F.when(F.coalesce(degrees(F.col("p_h")), F.lit(True)), F.lit("m")).otherwise(F.col("p_h"))),
        "stated": F.col("_rh").isNotNull() | F.col("_rv").isNotNull() | F.col("p_kind").isNotNull(),
        "by_remark": F.col("_rh").isNotNull() | F.col("_rv").isNotNull(),
        "raw_e": F.when(F.col("p_swap"), F.col("y")).otherwise(F.col("x")),
        "raw_n": F.when(F.col("p_swap"), F.col("x")).otherwise(F.col("y")),
    })
    geo = degrees(F.col("h"))
    # A linear unit with a geographic system (or none) is read in the common system.
    own = F.coalesce((F.col("p_kind") != "geo") & ~geo, F.lit(False))
    df = df.withColumns({
        "kind": F.when(geo, F.lit("geo")).when(own, F.col("p_kind")).otherwise(F.lit("tm")),
        "lon0": F.when(own, F.col("p_lon0")).otherwise(F.lit(9.0)),
        "k0": F.when(own, F.col("p_k0")).otherwise(F.lit(0.9996)),
        "x0": F.when(own, F.col("p_x0")).otherwise(F.lit(500000.0)),
        "y0": F.when(own, F.col("p_y0")).otherwise(F.lit(0.0)),
        "_f": metres(F.col("h")),
    })
    df = with_east_north(df, F.col("raw_e") * F.col("_f"), F.col("raw_n") * F.col("_f"), F.col("kind"), F.col("lon0"), F.col("k0"), F.col("x0"), F.col("y0"))
    return df.drop("_f", "_rh", "_rv", "s", "r_h", "r_v", "r_strip", "r_rest", "p_v", "p_h", "p_swap", "p_kind", "p_lon0", "p_k0", "p_x0", "p_y0")


def _near(e: Column, n: Column, reach: float) -> Column:
    return (F.abs(e - F.col("center_x")) <= reach) & (F.abs(n - F.col("center_y")) <= reach)


def common_units(records: DataFrame, scans: DataFrame, sites: DataFrame, reach: float = 6000.0, sure: float = 0.99) -> DataFrame:
    """Give every record its units and its coordinates in metres of EPSG:25832.

    Returns rec_id, h_unit, v_unit, x_m, y_m, z_m, basis (remark, system,
    position, none), confidence (the posterior where the position decides) and
    uncertain. Rows of null x or y come out with the stated units, null
    coordinates and basis none. A row whose site is unknown keeps what is
    stated; where nothing is stated, the mixture alone decides, against the
    mean distance of the sites from the origin. If the most probable unit does
    not put a row within ``reach`` of its site's centre, or no unit is as
    probable as none, the stated unit stays and the row is uncertain. NaN
    coordinates count as null. Repeated rows each come out; an empty table
    gives an empty result; other columns of the inputs are not read.
    """
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    clean = records.withColumns({c: number(c) for c in "xyz"})
    df = stated_units(clean, scans, sites)
    placed, known = F.col("raw_e").isNotNull() & F.col("raw_n").isNotNull(), F.col("center_x").isNotNull()
    df = df.withColumn("fits", F.when(placed & known, F.coalesce(_near(F.col("east"), F.col("north"), reach), F.lit(False))))
    far = lambda e, n: F.sqrt(F.col(e) ** 2 + F.col(n) ** 2)
    middle = sites.agg(F.avg(far("center_x", "center_y")).alias("m")).first()["m"]
    ratio = F.log10(far("raw_e", "raw_n")) - F.log10(F.coalesce(far("center_x", "center_y"), F.lit(middle).cast("double")))
    open_row = placed & F.coalesce(~F.col("stated") | ~F.col("fits"), F.lit(False))
    df = df.withColumn("_u", F.when(open_row & ratio.isNotNull(), F.greatest(F.least(ratio, F.lit(REACH)), F.lit(-REACH))))
    df = fence(df, "_u", "fits")
    histogram = df.where(F.col("_u").isNotNull()).groupBy(F.round(F.col("_u") / BIN).cast("int").alias("b")).count().collect()
    bins = np.array([r["b"] * BIN for r in histogram], dtype=float)
    counts = np.array([r["count"] for r in histogram], dtype=float)
    fit = fit_log_mixture(bins, counts, np.array([-math.log10(UNITS[u]) for u in POSITION_UNITS]))
    each = list(enumerate(POSITION_UNITS))
    df = df.withColumns({f"_in{i}": F.when(F.col("_u").isNotNull() & known, _near(F.col("raw_e") * UNITS[u], F.col("raw_n") * UNITS[u], reach)) for i, u in each})
    df = fence(df, *(f"_in{i}" for i, _ in each))
    df = fence(df.withColumns({f"_d{i}": F.when(F.col("_u").isNotNull(), _score(F.col("_u"), F.col(f"_in{i}"), u, fit["weights"][i], fit)) for i, u in each}), *(f"_d{i}" for i, _ in each))
    flat = F.lit(float(fit["weights"][-1]) / (2 * REACH))
    df = df.withColumns({"_best": F.greatest(flat, *(F.col(f"_d{i}") for i, _ in each)), "_all": sum((F.col(f"_d{i}") for i, _ in each), flat)})
    # The unit of highest posterior; the exact reach is checked after it, where there is a centre.
    choice = F.coalesce(*(F.when((F.col(f"_d{i}") == F.col("_best")) & F.coalesce(f"_in{i}", F.lit(True)), F.lit(i)) for i, _ in each))
    df = fence(df.withColumn("_which", choice), "_which", "_all")
    picked = lambda values: F.coalesce(*(F.when(F.col("_which") == i, v) for i, v in enumerate(values)))
    df = fence(df.withColumns({"_unit": picked([F.lit(u) for _, u in each]), "_p": picked([F.col(f"_d{i}") for i, _ in each]) / F.col("_all")}), "_unit", "_p")
    by_position = F.col("_unit").isNotNull()
    df = df.withColumns({
        "h_unit": F.coalesce("_unit", "h"), "v_unit": F.coalesce("_unit", "v"), "confidence": F.when(by_position, F.col("_p")).when(F.col("fits"), F.lit(1.0)).otherwise(F.lit(0.0)),
        "basis": F.when(F.col("raw_e").isNull() | F.col("raw_n").isNull(), F.lit("none")).when(by_position, F.lit("position")).when(F.col("by_remark"), F.lit("remark")).when(F.col("stated"), F.lit("system")).otherwise(F.lit("none")),
    })
    scale = metres(F.col("_unit"))
    return df.select(
        "rec_id", "h_unit", "v_unit",
        F.when(by_position, F.col("raw_e") * scale).otherwise(F.col("east")).alias("x_m"),
        F.when(by_position, F.col("raw_n") * scale).otherwise(F.col("north")).alias("y_m"),
        (F.col("z") * metres(F.col("v_unit"))).alias("z_m"),
        "basis", "confidence", (F.col("confidence") < sure).alias("uncertain"),
    )


def foreign_units(records: DataFrame, scans: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows with an x whose horizontal or vertical unit is not the metre."""
    placed = records.where(F.col("x").isNotNull() & ~F.isnan("x"))
    found = common_units(placed, scans, sites)
    return found.where((F.col("h_unit") != "m") | (F.col("v_unit") != "m")).select("rec_id", "h_unit", "v_unit")
