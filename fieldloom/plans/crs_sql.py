"""SQL of the unit and proximity queries: systems, remarks and projections told by patterns.

It restates the result for spellings as they occur in the tables, apart from the
operators' own parsers, so that the two can be held against each other.
"""

from __future__ import annotations

from fieldloom.functions import projection as P

#: Added before rounding, so that no recorded value lies where the engines round differently.
SHIFT = 0.0001234
_NUMBER = "[-+]?[0-9]*\\.?[0-9]+(?:[eE][-+]?[0-9]+)?"


def _named(factor: str) -> str:
    return f"CASE WHEN {factor} IS NULL THEN NULL WHEN abs({factor} - 1) < 1e-9 THEN 'm' WHEN abs({factor} - 1000) < 1e-9 THEN 'km' WHEN abs({factor} - 0.01) < 1e-12 THEN 'cm' WHEN abs({factor} - 0.001) < 1e-12 THEN 'mm' WHEN abs({factor} - 0.3048) < 1e-9 THEN 'ft' ELSE 'us-ft' END"


def factor(unit: str) -> str:
    return f"CASE {unit} WHEN 'm' THEN 1.0 WHEN 'km' THEN 1000.0 WHEN 'cm' THEN 0.01 WHEN 'mm' THEN 0.001 WHEN 'ft' THEN 0.3048 WHEN 'us-ft' THEN {1200 / 3937!r} WHEN 'deg' THEN 1.0 WHEN '1e-7 deg' THEN 1e-7 END"


def systems(table: str) -> str:
    """CTEs ending in ``sys(proj, kind, lon0, h, v, swap)`` for the spellings of a table."""
    pick = lambda key: f"TRY_CAST(nullif(regexp_extract(proj, '\\+{key}=({_NUMBER})', 1), '') AS DOUBLE)"
    word = lambda key: f"nullif(regexp_extract(proj, '\\+{key}=(us-ft|ft|km|cm|mm|m)( |$)', 1), '')"
    unit = f"regexp_extract_all(split_part(proj, 'VERT_CS', 1), 'UNIT\\[\"[^\"]*\",({_NUMBER})', 1)"
    up = f"TRY_CAST(nullif(regexp_extract(split_part(proj, 'VERT_CS', 2), 'UNIT\\[\"[^\"]*\",({_NUMBER})', 1), '') AS DOUBLE)"
    return f"""raw0 AS (SELECT DISTINCT proj FROM {table} WHERE proj IS NOT NULL),
    raw1 AS (SELECT proj, TRY_CAST(nullif(regexp_extract(proj, '(?i)epsg[: ]+([0-9]+) *$', 1), '') AS INT) AS code, contains(proj, '+proj') AS p4, contains(proj, 'PROJCS') AS pcs FROM raw0),
    raw2 AS (
        SELECT proj, swap, CASE WHEN code = 4326 OR regexp_matches(proj, 'longlat|latlong') OR starts_with(proj, 'GEOGCS') THEN 'geo' WHEN code = 3857 THEN 'merc' ELSE 'tm' END AS kind,
            CASE WHEN code > 0 AND code NOT IN (4326, 3857) THEN (code % 100) * 6.0 - 183 WHEN p4 THEN coalesce({pick("zone")} * 6 - 183, {pick("lon_0")}, 9)
                WHEN pcs THEN TRY_CAST(regexp_extract(proj, 'central_meridian",({_NUMBER})', 1) AS DOUBLE) ELSE 9.0 END AS lon0,
            CASE WHEN p4 THEN coalesce({_named(pick("to_meter"))}, {word("units")}, 'm') WHEN pcs THEN {_named(f"TRY_CAST({unit}[-1] AS DOUBLE)")} ELSE 'm' END AS hu,
            CASE WHEN p4 THEN coalesce({_named(pick("vto_meter"))}, {word("vunits")}) ELSE {_named(up)} END AS v
        FROM (SELECT *, regexp_matches(proj, '\\+axis=n') AS swap FROM raw1)),
    sys AS (SELECT proj, kind, lon0, CASE WHEN kind = 'geo' THEN 'deg' ELSE hu END AS h, v, swap FROM raw2)"""


def to_zone(source: str, target: str, keep: str) -> str:
    """CTEs that take ``source(keep..., e, n, kind, lon0)``, metres or degrees, to ``target(keep..., east, north)``."""
    k = repr(P.UTM_SCALE * P._RECT)
    term = lambda cs, a, b, x, y: " ".join(f"{'+' if c >= 0 else '-'} {abs(c)!r} * {a}({2 * j} * {x}) * {b}({2 * j} * {y})" for j, c in enumerate(cs, 1))
    minus = tuple(-c for c in P._INVERSE)
    lat = " ".join(f"{'+' if c >= 0 else '-'} {abs(c)!r} * sin({2 * j} * chi)" for j, c in enumerate(P._LATITUDE, 1))
    e = repr(P._ECC)
    return f"""{target}0 AS (SELECT *, kind = 'tm' AND lon0 = 9 AS native, CASE WHEN kind = 'tm' AND lon0 <> 9 THEN n / {k} END AS xi, CASE WHEN kind = 'tm' AND lon0 <> 9 THEN (e - 500000) / {k} END AS eta FROM {source}),
    {target}1 AS (SELECT *, xi {term(minus, "sin", "cosh", "xi", "eta")} AS xi1, eta {term(minus, "cos", "sinh", "xi", "eta")} AS eta1 FROM {target}0),
    {target}2 AS (SELECT *, asin(sin(xi1) / cosh(eta1)) AS chi FROM {target}1),
    {target}3 AS (SELECT *, CASE kind WHEN 'geo' THEN e WHEN 'merc' THEN degrees(e / {P.SPHERE!r}) ELSE lon0 + degrees(atan2(sinh(eta1), cos(xi1))) END AS lon,
        CASE kind WHEN 'geo' THEN n WHEN 'merc' THEN degrees(2 * atan(exp(n / {P.SPHERE!r})) - pi() / 2) ELSE degrees(chi {lat}) END AS lat FROM {target}2),
    {target}4 AS (SELECT *, radians(lon - 9) AS dl, CASE WHEN NOT native AND abs(lat) < 89.9 THEN sin(radians(lat)) END AS sl FROM {target}3),
    {target}5 AS (SELECT *, sinh(atanh(sl) - {e} * atanh({e} * sl)) AS t FROM {target}4),
    {target}6 AS (SELECT *, atan2(t, cos(dl)) AS f, asinh(sin(dl) / sqrt(t * t + cos(dl) * cos(dl))) AS g FROM {target}5),
    {target} AS (SELECT {keep}, CASE WHEN native THEN e ELSE 500000 + {k} * (g {term(P._FORWARD, "cos", "sinh", "f", "g")}) END AS east, CASE WHEN native THEN n ELSE {k} * (f {term(P._FORWARD, "sin", "cosh", "f", "g")}) END AS north FROM {target}6)"""


_U = "(US survey feet|survey feet \\(US\\)|US-ft|ftUS|international feet|ft \\(international\\)|feet \\(0\\.3048 m\\)|Kilometern|kilometres|km|Zentimetern|centimetres|cm|Millimetern|millimetres|mm|Metern|metres|m)"


def _unit(text: str) -> str:
    return f"CASE WHEN {text} = '' OR {text} IS NULL THEN NULL WHEN contains({text}, 'US') THEN 'us-ft' WHEN regexp_matches({text}, 'feet|ft') THEN 'ft' WHEN regexp_matches({text}, '^[kK]') THEN 'km' WHEN regexp_matches({text}, '^[cZ]') THEN 'cm' WHEN regexp_matches({text}, '^(mm|[mM]illi)') THEN 'mm' ELSE 'm' END"


def _said(*patterns: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(remark, '{p}', 1), '')" for p in patterns) + ")"


def units_sql(positions: bool = False) -> str:
    """Units of the rows not in metres, or with ``positions`` the units and coordinates of all rows with an x."""
    every = _said(f"(?:[Aa]ll coordinates in|Coordinates delivered in|Koordinaten in|coords:|xyz are|unit of the export was) {_U}")
    plan = _said(f"(?:Easting/northing in|plan coordinates are|plan in) {_U}", f"x/y \\[{_U}\\]")
    height = _said(f"(?:[Hh]eights in|vertical values recorded as|H in|Elevations are) {_U}", f"z \\[{_U}\\]", "z stays metric \\((m)\\)")
    near = "abs({0} - center_x) <= 6000 AND abs({1} - center_y) <= 6000"
    fit = " ".join(f"WHEN {near.format(f'raw_e * {f}', f'raw_n * {f}')} THEN '{u}'" for u, f in (("m", "1"), ("km", "1000"), ("cm", "0.01"), ("mm", "0.001")))
    end = "SELECT rec_id, coalesce(got, h) AS h_unit, coalesce(got, v) AS v_unit FROM k WHERE coalesce(got, h) <> 'm' OR coalesce(got, v) <> 'm'"
    if positions:
        shown = lambda c: f"round({c} + {SHIFT!r}, 2)"
        end = f"""SELECT rec_id, coalesce(got, h) AS h_unit, coalesce(got, v) AS v_unit, {shown(f"CASE WHEN got IS NULL THEN east ELSE raw_e * ({factor('got')}) END")} AS x_m,
            {shown(f"CASE WHEN got IS NULL THEN north ELSE raw_n * ({factor('got')}) END")} AS y_m, {shown(f"z * ({factor('coalesce(got, v)')})")} AS z_m FROM k JOIN georecords USING (rec_id)"""
    return f"""WITH {systems("scans")},
    m0 AS (SELECT scan_id, proj, {every} AS a, {plan} AS p, {height} AS z, coalesce(regexp_matches(remark, '1e-7 deg|degrees times 10,000,000'), FALSE) AS deg,
        TRY_CAST(nullif(regexp_extract(remark, '(?:Flight line|Strip|pt_src_id) ([0-9]+)', 1), '') AS INT) AS strip, nullif(regexp_extract(remark, 'others in {_U}', 1), '') AS o FROM scans),
    m AS (SELECT scan_id, proj, CASE WHEN deg THEN '1e-7 deg' ELSE {_unit("coalesce(a, p)")} END AS rh, {_unit("coalesce(a, z)")} AS rv, strip, {_unit("o")} AS rest FROM m0),
    j AS (
        SELECT g.rec_id, g.x, g.y, center_x, center_y, kind, lon0, s.h AS ph, s.v AS pv, coalesce(swap, FALSE) AS swap, strip IS NULL OR g.pt_src_id = strip AS mine, rh, rv, rest, s.proj IS NOT NULL AS has
        FROM georecords g LEFT JOIN m USING (scan_id) LEFT JOIN sys s ON s.proj = m.proj LEFT JOIN sites USING (site_id) WHERE x IS NOT NULL AND NOT isnan(x)),
    u AS (SELECT *, CASE WHEN rh IS NULL THEN NULL WHEN mine THEN rh ELSE rest END AS hr, CASE WHEN rv IS NULL THEN NULL WHEN mine THEN rv ELSE rest END AS vr FROM j),
    w AS (SELECT *, coalesce(hr, ph, 'm') AS h, coalesce(vr, pv, CASE WHEN ph IS NULL OR ph = 'deg' THEN 'm' ELSE ph END) AS v, hr IS NOT NULL OR vr IS NOT NULL OR has AS stated,
        CASE WHEN swap THEN y ELSE x END AS raw_e, CASE WHEN swap THEN x ELSE y END AS raw_n FROM u),
    b AS (SELECT rec_id, raw_e, raw_n, center_x, center_y, h, v, stated, raw_e * ({factor("h")}) AS e, raw_n * ({factor("h")}) AS n,
        CASE WHEN h IN ('deg', '1e-7 deg') THEN 'geo' WHEN kind = 'geo' OR kind IS NULL THEN 'tm' ELSE kind END AS kind, CASE WHEN h IN ('deg', '1e-7 deg') OR kind = 'geo' OR kind IS NULL THEN 9.0 ELSE lon0 END AS lon0 FROM w),
    {to_zone("b", "t", "rec_id, raw_e, raw_n, center_x, center_y, h, v, stated")},
    k AS (SELECT rec_id, h, v, raw_e, raw_n, east, north, CASE WHEN center_x IS NULL OR (stated AND coalesce({near.format("east", "north")}, FALSE)) THEN NULL ELSE CASE {fit} END END AS got FROM t) {end}"""


def proximity_sql() -> str:
    return f"""WITH {systems("(SELECT proj FROM stemroots UNION SELECT proj FROM plots)")},
    a AS (SELECT rec_id, CASE WHEN coalesce(swap, FALSE) THEN y ELSE x END * ({factor("coalesce(h, 'm')")}) AS e, CASE WHEN coalesce(swap, FALSE) THEN x ELSE y END * ({factor("coalesce(h, 'm')")}) AS n,
        coalesce(kind, 'tm') AS kind, coalesce(lon0, 9.0) AS lon0 FROM stemroots LEFT JOIN sys USING (proj) WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)),
    {to_zone("a", "t", "rec_id")},
    r AS (SELECT plot_id, list_transform(regexp_extract_all(ring, '{_NUMBER}'), lambda s: CAST(s AS DOUBLE) * ({factor("coalesce(h, 'm')")})) AS c FROM plots LEFT JOIN sys USING (proj)),
    q AS (SELECT plot_id, list_transform(generate_series(1, len(c) // 2), lambda i: c[2 * i - 1]) AS xs, list_transform(generate_series(1, len(c) // 2), lambda i: c[2 * i]) AS ys FROM r),
    b AS (SELECT *, list_min(xs) AS x0, list_max(xs) AS x1, list_min(ys) AS y0, list_max(ys) AS y1, len(xs) AS n FROM q)
    SELECT 'near' AS kind, p.rec_id AS id_a, o.rec_id AS id_b FROM t p JOIN t o ON o.east BETWEEN p.east - 1 AND p.east + 1 AND o.north BETWEEN p.north - 1 AND p.north + 1 AND p.rec_id < o.rec_id
    WHERE (p.east - o.east) * (p.east - o.east) + (p.north - o.north) * (p.north - o.north) <= 1
    UNION ALL
    SELECT 'within', rec_id, plot_id FROM t JOIN b ON east BETWEEN x0 AND x1 AND north BETWEEN y0 AND y1
    WHERE list_sum(list_transform(generate_series(1, n), lambda i: CASE WHEN (ys[i] > north) <> (ys[CASE WHEN i = 1 THEN n ELSE i - 1 END] > north) AND east < (xs[CASE WHEN i = 1 THEN n ELSE i - 1 END] - xs[i])
        * (north - ys[i]) / (ys[CASE WHEN i = 1 THEN n ELSE i - 1 END] - ys[i]) + xs[i] THEN 1 ELSE 0 END)) % 2 = 1"""
