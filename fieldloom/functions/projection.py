"""Map projections as column expressions, and the parsing of how a system is named.

The target of every conversion here is EPSG:25832. Sources may be transverse
Mercator with any central meridian, spherical Mercator or geographic degrees.
ETRS89 and WGS 84 are taken as one datum, as their difference is below the
accuracy of the records.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ellipsoid GRS 1980, UTM constants, radius of spherical Mercator.
AXIS = 6378137.0
FLATTENING = 1 / 298.257222101
UTM_SCALE = 0.9996
UTM_EAST = 500000.0
SPHERE = 6378137.0

# Metres per unit, as named in the results.
UNITS = {"m": 1.0, "km": 1000.0, "cm": 0.01, "mm": 0.001, "ft": 0.3048, "us-ft": 1200 / 3937}
DEGREES = {"deg": 1.0, "1e-7 deg": 1e-7}

_N = FLATTENING / (2 - FLATTENING)
_ECC = math.sqrt(FLATTENING * (2 - FLATTENING))
_RECT = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Coefficients of the Krueger series to the fourth order.
_FORWARD = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_INVERSE = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_LATITUDE = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def lonlat_to_tm(lon: Column, lat: Column, lon0: Column | float, k0: float = UTM_SCALE, x0: float = UTM_EAST) -> tuple[Column, Column]:
    """Degrees to transverse Mercator metres (Krueger series, about 0.1 mm within a zone)."""
    lon0 = lon0 if isinstance(lon0, Column) else F.lit(float(lon0))
    delta, sin_lat = F.radians(lon - lon0), F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sin_lat) - _ECC * F.atanh(_ECC * sin_lat))
    xi = F.atan2(t, F.cos(delta))
    eta = F.asinh(F.sin(delta) / F.sqrt(t * t + F.cos(delta) * F.cos(delta)))
    east, north = eta, xi
    for j, c in enumerate(_FORWARD, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return x0 + k0 * _RECT * east, k0 * _RECT * north


def tm_to_lonlat(east: Column, north: Column, lon0: Column | float, k0: Column | float = UTM_SCALE, x0: Column | float = UTM_EAST) -> tuple[Column, Column]:
    """Transverse Mercator metres to degrees."""
    lon0 = lon0 if isinstance(lon0, Column) else F.lit(float(lon0))
    xi, eta = north / (k0 * _RECT), (east - x0) / (k0 * _RECT)
    xi1, eta1 = xi, eta
    for j, c in enumerate(_INVERSE, 1):
        xi1 = xi1 - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, c in enumerate(_LATITUDE, 1):
        lat = lat + c * F.sin(2 * j * chi)
    return lon0 + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(lat)


def mercator_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """Spherical Mercator metres (EPSG:3857) to degrees."""
    return F.degrees(x / SPHERE), F.degrees(F.lit(2.0) * F.atan(F.exp(y / SPHERE)) - math.pi / 2)


def lonlat_to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to spherical Mercator metres (EPSG:3857)."""
    return SPHERE * F.radians(lon), SPHERE * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def _unit_of(factor: float) -> str | None:
    for name, metres in UNITS.items():
        if abs(factor / metres - 1) < 5e-7:
            return name
    return None


_EPSG = re.compile(r"^\s*(?:\+init=)?(?:urn:ogc:def:crs:)?epsg[:\s]+(?:[\d.]*:)?(\d+)\s*$", re.I)
_WKT_UNIT = re.compile(r'UNIT\s*[\[(]\s*"([^"]*)"\s*,\s*([-+\d.eE]+)', re.I)


def parse_proj(text: str | None) -> dict | None:
    """Read EPSG text, a proj4 string or WKT.

    Returns ``kind`` (tm, merc, geo), ``lon0``, ``k0``, ``x0`` and ``y0`` in
    metres, ``h`` and ``v`` (unit names, ``v`` None where not stated) and
    ``swap`` (x is the northing). None, empty and unreadable texts give None.
    """
    if text is None or not text.strip():
        return None
    out = {"kind": "tm", "lon0": 9.0, "k0": UTM_SCALE, "x0": UTM_EAST, "y0": 0.0, "h": "m", "v": None, "swap": False}
    if found := _EPSG.match(text):
        code = int(found[1])
        if code in (4326, 4258):
            return out | {"kind": "geo", "h": "deg"}
        if code in (3857, 900913, 3785):
            return out | {"kind": "merc"}
        if 32601 <= code <= 32660 or 25828 <= code <= 25838:
            return out | {"lon0": (code % 100) * 6.0 - 183.0}
        return None
    if "+proj" in text:
        return _parse_proj4(text, out)
    if re.search(r"(PROJCS|GEOGCS|COMPD_CS|PROJCRS)\s*[\[(]", text, re.I):
        return _parse_wkt(text, out)
    return None


def _parse_proj4(text: str, out: dict) -> dict | None:
    parts = dict((p.lstrip("+").split("=", 1) + [""])[:2] for p in text.split() if p.startswith("+"))
    kind = parts.get("proj", "")
    number = lambda key, default: float(parts.get(key) or default)
    if kind in ("longlat", "latlong", "lonlat", "latlon"):
        out |= {"kind": "geo", "h": "deg"}
    elif kind == "utm":
        out["lon0"] = number("zone", 32) * 6 - 183
    elif kind == "tmerc":
        out |= {"lon0": number("lon_0", 0), "k0": number("k", 0) or number("k_0", 1), "x0": number("x_0", 0), "y0": number("y_0", 0)}
    elif kind in ("merc", "webmerc"):
        out["kind"] = "merc"
    else:
        return None
    if out["kind"] != "geo":
        if "to_meter" in parts:
            out["h"] = _unit_of(float(parts["to_meter"])) or "m"
        elif parts.get("units") in UNITS:
            out["h"] = parts["units"]
    if "vto_meter" in parts:
        out["v"] = _unit_of(float(parts["vto_meter"]))
    elif parts.get("vunits") in UNITS:
        out["v"] = parts["vunits"]
    out["swap"] = parts.get("axis", "enu")[:1] == "n"
    return out


def _parse_wkt(text: str, out: dict) -> dict | None:
    flat, _, vertical = re.sub(r"\s+", " ", text).partition("VERT_CS")
    units = _WKT_UNIT.findall(flat)
    if vertical and (found := _WKT_UNIT.search(vertical)):
        out["v"] = _unit_of(float(found[2]))
    if not re.search(r"PROJCS", flat, re.I):
        return out | {"kind": "geo", "h": "deg"}
    out["h"] = (_unit_of(float(units[-1][1])) if units else None) or "m"
    value = lambda name, default: float(m[1]) if (m := re.search(rf'PARAMETER\s*\[\s*"{name}"\s*,\s*([-+\d.eE]+)', flat, re.I)) else default
    if re.search(r'PROJECTION\s*\[\s*"Mercator', flat, re.I):
        return out | {"kind": "merc"}
    metres = UNITS[out["h"]]
    out |= {"lon0": value("central_meridian", 9.0), "k0": value("scale_factor", UTM_SCALE), "x0": value("false_easting", 0.0) * metres, "y0": value("false_northing", 0.0) * metres}
    axes = re.findall(r'AXIS\s*\[\s*"[^"]*"\s*,\s*(\w+)', flat, re.I)
    out["swap"] = bool(axes) and axes[0].upper() == "NORTH"
    return out


# Spellings of units in remarks, longest and most specific first.
_SPELLINGS = (
    ("us-ft", r"us[ -]survey[ -]f(?:ee|oo)t|survey[ -]f(?:ee|oo)t(?: \(us\))?|us[ -]?ft|ftus|us[ -]f(?:ee|oo)t|us-vermessungsfu(?:ß|ss)"),
    ("ft", r"international f(?:ee|oo)t|f(?:ee|oo)t(?: \(0\.3048 m\)| \(international\))?|ft(?: \(international\))?|fu(?:ß|ss)"),
    ("km", r"kilomet(?:ers?|res?|ern)|km"),
    ("cm", r"[cz]entimet(?:ers?|res?|ern)|cm"),
    ("mm", r"millimet(?:ers?|res?|ern)|mm"),
    ("m", r"met(?:ers?|res?|ern)|m"),
)
_ANY_UNIT = "|".join(f"(?P<u{i}>{p})" for i, (_, p) in enumerate(_SPELLINGS))
_UNIT = re.compile(rf"(?<![\w.])(?:{_ANY_UNIT})(?![\w-])", re.I)
_DEGREE = re.compile(r"1e-?7[ -]?deg|degrees? (?:times|x|\*) 10[, .']?000[, .']?000|1e-7 grad", re.I)
_STRIP = re.compile(r"\b(?:flight line|strip|pt_src_id|streifen|flugstreifen)\s*(?:no\.?|nr\.?|=)?\s*(\d+)", re.I)
_ALL = re.compile(r"all coordinates|coordinates delivered|koordinaten in|coords\s*:|\bxyz\b|unit of the export|every axis|x, y and z|alle koordinaten|(?<!plan )coordinates (?:are|in)\b", re.I)
_PLAN = re.compile(r"easting|northing|plan\b|plan coordinates|x\s*[/,]\s*y|rechtswert|hochwert|lon/lat|horizontal|lage\b", re.I)
_HEIGHT = re.compile(r"\bheights?\b|\belevations?\b|\bvertical\b|\bz\b|\bh(?= in\b)|\bh[öo]hen?\b", re.I)


def _first_unit(text: str) -> str | None:
    found = _UNIT.search(text)
    if not found:
        return None
    return next(_SPELLINGS[i][0] for i in range(len(_SPELLINGS)) if found[f"u{i}"])


def parse_remark(text: str | None) -> dict | None:
    """What a remark says about units of coordinates, or None.

    Returns ``h``, ``v`` (None: not stated), ``strip`` (None: all rows) and
    ``rest`` (unit of the rows outside the strip, for the same axes). Lengths
    of other things (footprints, heights flown, accuracies) are passed over:
    only clauses that name coordinates or axes count.
    """
    if text is None:
        return None
    out = {"h": None, "v": None, "strip": None, "rest": None}
    sentences = re.split(r"(?<=[.!])\s+(?=[A-ZÄÖÜ])", text)
    for sentence in sentences:
        strip = _STRIP.search(sentence)
        body = sentence[strip.end():] if strip else sentence
        stated = False
        rest = None
        if strip and (others := re.search(r"\b(?:others?|rest|übrige)\b(.*)", body, re.I)):
            rest, body = _first_unit(others[1]), body[: others.start()]
        if _DEGREE.search(body):
            out["h"], stated = "1e-7 deg", True
            tail = body[_DEGREE.search(body).end():]
            if _HEIGHT.search(tail) and (unit := _first_unit(tail[_HEIGHT.search(tail).start():])):
                out["v"] = unit
        elif _ALL.search(body) and (unit := _first_unit(body[_ALL.search(body).start():])):
            out["h"] = out["v"] = unit
            stated = True
        else:
            for clause in re.split(r"[,;](?![^\[(]*[\])])\s*(?!y\b)", body):
                if _HEIGHT.search(clause) and not _PLAN.search(clause):
                    if unit := _height_unit(clause):
                        out["v"], stated = unit, True
                elif _PLAN.search(clause) and (unit := _first_unit(clause[_PLAN.search(clause).start():])):
                    out["h"], stated = unit, True
        if stated and strip:
            out["strip"], out["rest"] = int(strip[1]), rest
    return out if out["h"] or out["v"] else None


def _height_unit(clause: str) -> str | None:
    """The unit a clause gives for heights; "900 ft above ground" and the like give none."""
    after = clause[_HEIGHT.search(clause).end():]
    if re.match(r"\s*(?:are|is|in|stays?|recorded|values|\[|:|=)", after, re.I) or re.search(r"recorded|metric|\[", after, re.I):
        return _first_unit(after)
    return None


@lru_cache(maxsize=65536)
def cached_proj(text: str | None) -> dict | None:
    return parse_proj(text)


@lru_cache(maxsize=65536)
def cached_remark(text: str | None) -> dict | None:
    return parse_remark(text)


def _tm_inverse(east: np.ndarray, north: np.ndarray, lon0: np.ndarray, k0: np.ndarray, x0: np.ndarray, y0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    xi, eta = (north - y0) / (k0 * _RECT), (east - x0) / (k0 * _RECT)
    xi1, eta1 = xi.copy(), eta.copy()
    for j, c in enumerate(_INVERSE, 1):
        xi1 -= c * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        eta1 -= c * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    chi = np.arcsin(np.sin(xi1) / np.cosh(eta1))
    lat = chi + sum(c * np.sin(2 * j * chi) for j, c in enumerate(_LATITUDE, 1))
    return lon0 + np.degrees(np.arctan2(np.sinh(eta1), np.cos(xi1))), np.degrees(lat)


def _tm_forward(lon: np.ndarray, lat: np.ndarray, lon0: float = 9.0) -> tuple[np.ndarray, np.ndarray]:
    delta, sin_lat = np.radians(lon - lon0), np.sin(np.radians(np.where(np.abs(lat) < 89.9, lat, np.nan)))
    t = np.sinh(np.arctanh(sin_lat) - _ECC * np.arctanh(_ECC * sin_lat))
    xi, eta = np.arctan2(t, np.cos(delta)), np.arcsinh(np.sin(delta) / np.hypot(t, np.cos(delta)))
    east, north = eta.copy(), xi.copy()
    for j, c in enumerate(_FORWARD, 1):
        east += c * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        north += c * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    return UTM_EAST + UTM_SCALE * _RECT * east, UTM_SCALE * _RECT * north


def east_north_arrays(x: np.ndarray, y: np.ndarray, kind: np.ndarray, lon0: np.ndarray, k0: np.ndarray, x0: np.ndarray, y0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EPSG:25832 metres of coordinates given in the system of each element.

    ``kind`` is tm, merc or geo; x and y are metres, or degrees for geo. Values
    that have no place in the target come out as NaN.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    east, north = x.copy(), y.copy()
    native = (kind == "tm") & (lon0 == 9.0) & (np.abs(k0 - UTM_SCALE) < 1e-9) & (np.abs(x0 - UTM_EAST) < 0.001) & (np.abs(y0) < 0.001)
    todo = np.flatnonzero(~native)
    if not len(todo):
        return east, north
    lon, lat, k = x[todo], y[todo], kind[todo]
    with np.errstate(all="ignore"):
        if (m := k == "merc").any():
            lon[m], lat[m] = np.degrees(lon[m] / SPHERE), np.degrees(2 * np.arctan(np.exp(lat[m] / SPHERE)) - math.pi / 2)
        if (m := k == "tm").any():
            at = todo[m]
            lon[m], lat[m] = _tm_inverse(x[at], y[at], lon0[at], k0[at], x0[at], y0[at])
        east[todo], north[todo] = _tm_forward(lon, lat)
    return east, north


@F.pandas_udf(T.StructType([T.StructField("east", T.DoubleType()), T.StructField("north", T.DoubleType())]))
def _east_north(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for x, y, kind, lon0, k0, x0, y0 in batches:
        e, n = east_north_arrays(*(s.to_numpy() for s in (x, y, kind, lon0, k0, x0, y0)))
        yield pd.DataFrame({"east": np.where(np.isfinite(e), e, np.nan), "north": np.where(np.isfinite(n), n, np.nan)})


# Filters on the result must not repeat the call, so the optimiser may not move them past it.
_east_north = _east_north.asNondeterministic()


def with_east_north(df: DataFrame, x: Column, y: Column, kind: Column, lon0: Column, k0: Column, x0: Column, y0: Column) -> DataFrame:
    """Add ``east`` and ``north``, metres of EPSG:25832, in one vectorised Arrow call.

    As column expressions the chained series grow beyond what the optimiser
    handles (each stage is a long alias whose constraints are combined), so
    this conversion between arbitrary systems runs in numpy. Null coordinates
    and places outside the projection give null.
    """
    e = _east_north(x, y, kind, lon0, k0, x0, y0)
    value = lambda c: F.when(~F.isnan(F.col(f"_en.{c}")), F.col(f"_en.{c}"))
    return df.withColumn("_en", e).withColumns({"east": value("east"), "north": value("north")}).drop("_en")


def reproject(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """x and y from one named system to another.

    Systems are EPSG:4326 and EPSG:4258 (degrees), EPSG:3857 and the UTM zones
    of WGS 84 and ETRS89, in any spelling that ``parse_proj`` reads. To and from
    degrees and spherical Mercator, and from these to a zone, the results are
    plain expressions. From a zone they come from one vectorised Arrow call, as
    the nested series would make an expression of many thousand nodes.
    """
    a, b = parse_proj(source), parse_proj(target)
    if a is None or b is None:
        raise ValueError(f"unknown system: {source if a is None else target}")
    if a == b:
        return x, y
    if a["swap"]:
        x, y = y, x
    scale = UNITS.get(a["h"], 1.0)
    x, y = (x * scale, y * scale) if scale != 1 else (x, y)
    if a["kind"] == "tm":
        both = _from_zone(a, b)(x, y)
        east, north = both["x"], both["y"]
    else:
        lon, lat = mercator_to_lonlat(x, y) if a["kind"] == "merc" else (x, y)
        if b["kind"] == "tm":
            east, north = lonlat_to_tm(lon, lat, b["lon0"], b["k0"], b["x0"])
            east, north = east / UNITS[b["h"]], (north + b["y0"]) / UNITS[b["h"]]
        else:
            east, north = lonlat_to_mercator(lon, lat) if b["kind"] == "merc" else (lon, lat)
    return (north, east) if b["swap"] else (east, north)


def _from_zone(a: dict, b: dict):  # noqa: ANN202
    """Arrow function from metres of one zone to another system."""

    @F.pandas_udf(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, y in batches:
            east, north = x.to_numpy(float, na_value=np.nan), y.to_numpy(float, na_value=np.nan)
            full = lambda v: np.full(len(east), float(v))  # noqa: E731, B023
            with np.errstate(all="ignore"):
                lon, lat = _tm_inverse(east, north, full(a["lon0"]), full(a["k0"]), full(a["x0"]), full(a["y0"]))
                if b["kind"] == "merc":
                    lon, lat = SPHERE * np.radians(lon), SPHERE * np.log(np.tan(math.pi / 4 + np.radians(lat) / 2))
                elif b["kind"] == "tm":
                    lon, lat = _tm_forward(lon, lat, b["lon0"])
                    lon, lat = ((lon - UTM_EAST) * b["k0"] / UTM_SCALE + b["x0"]) / UNITS[b["h"]], (lat * b["k0"] / UTM_SCALE + b["y0"]) / UNITS[b["h"]]
            yield pd.DataFrame({"x": lon, "y": lat})

    return run


def wkt(code: int) -> str:
    """WKT of the systems known here; ``parse_proj`` reads it back."""
    said = parse_proj(f"EPSG:{code}")
    if said is None:
        raise ValueError(f"EPSG:{code} is not known")
    globe = code == 4326 or 32600 < code < 32700 or said["kind"] == "merc"
    name, datum, ball, inverse = ("WGS 84", "WGS_1984", "WGS 84", 298.257223563) if globe else ("ETRS89", "European_Terrestrial_Reference_System_1989", "GRS 1980", 298.257222101)
    base = f'GEOGCS["{name}",DATUM["{datum}",SPHEROID["{ball}",6378137,{inverse}]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]'
    if said["kind"] == "geo":
        return base
    if said["kind"] == "merc":
        return f'PROJCS["{name} / Pseudo-Mercator",{base},PROJECTION["Mercator_1SP"],PARAMETER["central_meridian",0],UNIT["metre",1],AUTHORITY["EPSG","{code}"]]'
    zone = round((said["lon0"] + 183) / 6)
    return f'PROJCS["{name} / UTM zone {zone}N",{base},PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",{said["lon0"]:g}],PARAMETER["scale_factor",{UTM_SCALE}],PARAMETER["false_easting",{UTM_EAST:g}],PARAMETER["false_northing",0],UNIT["metre",1]]'


def epsg(code: int) -> str:
    """proj4 text of the systems known here."""
    said = parse_proj(f"EPSG:{code}")
    if said is None:
        raise ValueError(f"EPSG:{code} is not known")
    if said["kind"] == "geo":
        return "+proj=longlat +datum=WGS84 +no_defs"
    if said["kind"] == "merc":
        return "+proj=merc +a=6378137 +b=6378137 +units=m +no_defs"
    return f"+proj=utm +zone={round((said['lon0'] + 183) / 6)} +{'datum=WGS84' if code > 30000 else 'ellps=GRS80'} +units=m +no_defs"
