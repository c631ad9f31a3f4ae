"""LAS 1.0 to 1.3 files, point formats 0 to 5, by the public layout of the format."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, Filter, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual

from fieldloom.functions.affine import compose
from fieldloom.operators.frame import Extent
from fieldloom.sources.base import Header, OneFileWriter, RangeReader, register, save

# Layout of the point formats.
_CORE = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("class", "u1"), ("scan_angle_rank", "i1"), ("user_data", "u1"), ("pt_src_id", "<u2")]
_GPS, _RGB, _WAVE = [("gps_time", "<f8")], [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")], [("wave", "V29")]
FORMATS = {0: _CORE, 1: _CORE + _GPS, 2: _CORE + _RGB, 3: _CORE + _GPS + _RGB, 4: _CORE + _GPS + _WAVE, 5: _CORE + _GPS + _RGB + _WAVE}
SCHEMA = (
    "x double, y double, z double, intensity int, classification smallint, return_num smallint, num_returns smallint, synthetic boolean, keypoint boolean, withheld boolean, "
    "scan_direction_flag boolean, edge_of_flight_line boolean, pt_src_id int, scan_angle_rank tinyint, user_data smallint, gps_time double, red int, green int, blue int"
)
_ARROW = pa.schema([
    ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64()), ("intensity", pa.int32()), ("classification", pa.int16()), ("return_num", pa.int16()), ("num_returns", pa.int16()),
    ("synthetic", pa.bool_()), ("keypoint", pa.bool_()), ("withheld", pa.bool_()), ("scan_direction_flag", pa.bool_()), ("edge_of_flight_line", pa.bool_()), ("pt_src_id", pa.int32()),
    ("scan_angle_rank", pa.int8()), ("user_data", pa.int16()), ("gps_time", pa.float64()), ("red", pa.int32()), ("green", pa.int32()), ("blue", pa.int32()),
])


def read_header(path: str) -> Header:
    """Header of a file: count, extent, matrix of the offset, system and date."""
    with open(path, "rb") as file:
        head = file.read(375)
        if head[:4] != b"LASF":
            raise ValueError(f"{path} is not a LAS file")
        day, year, size, offset, vlrs, kind, length, count = struct.unpack_from("<HHHIIBHI", head, 90)
        scale = np.array(struct.unpack_from("<3d", head, 131))
        shift = np.array(struct.unpack_from("<3d", head, 155))
        xh, xl, yh, yl, zh, zl = struct.unpack_from("<6d", head, 179)
        crs = None
        file.seek(size)
        for _ in range(vlrs):
            item = file.read(54)
            if len(item) < 54:
                break
            _, _, record, n, _ = struct.unpack("<H16sHH32s", item)
            body = file.read(n)
            if record == 2112:
                crs = body.rstrip(b"\0").decode("utf-8", "replace")
    kind &= 0x3F
    if kind not in FORMATS:
        raise ValueError(f"point format {kind} is not supported")
    date = datetime(year, 1, 1) + timedelta(days=day - 1) if year and day else None
    box = Extent((xl, yl, zl), (xh, yh, zh)) if count else None
    return Header(path, count, compose(t=shift), box, crs, date, {"scale": scale, "offset": shift, "start": offset, "length": length, "format": kind})


def _rows(header: Header, start: int, end: int, box: dict[str, tuple[float, float]] | None = None) -> Iterator[pa.RecordBatch]:
    kind = np.dtype(FORMATS[header.more["format"]])
    length = header.more["length"]
    layout = np.dtype({"names": kind.names, "formats": [kind.fields[n][0] for n in kind.names], "offsets": [kind.fields[n][1] for n in kind.names], "itemsize": length})
    with open(header.path, "rb") as file:
        for at in range(start, end, 65536):
            n = min(65536, end - at)
            file.seek(header.more["start"] + at * length)
            rec = np.frombuffer(file.read(n * length), layout, count=n)
            if box:  # on raw numbers, before anything is scaled
                keep = np.ones(n, bool)
                for i, (axis, raw) in enumerate(zip("xyz", "XYZ")):
                    if axis in box:
                        low, high = ((v - header.more["offset"][i]) / header.more["scale"][i] for v in box[axis])
                        keep &= (rec[raw] >= np.floor(low)) & (rec[raw] <= np.ceil(high))
                rec = rec[keep]
            if not len(rec):
                continue
            col = {a: rec[r] * header.more["scale"][i] + header.more["offset"][i] for i, (a, r) in enumerate(zip("xyz", "XYZ"))}
            flags, cls = rec["flags"], rec["class"]
            col |= {"intensity": rec["intensity"], "classification": cls & 31, "return_num": flags & 7, "num_returns": (flags >> 3) & 7}
            col |= {"synthetic": cls & 32 > 0, "keypoint": cls & 64 > 0, "withheld": cls & 128 > 0, "scan_direction_flag": flags & 64 > 0, "edge_of_flight_line": flags & 128 > 0}
            col |= {n: rec[n] for n in ("pt_src_id", "scan_angle_rank", "user_data")}
            arrays = []
            for f in _ARROW:
                source = col.get(f.name, rec[f.name] if f.name in kind.names else None)
                arrays.append(pa.nulls(len(rec), f.type) if source is None else pa.array(np.ascontiguousarray(source)).cast(f.type))
            yield pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


class LasFilterReader(RangeReader):
    """Row ranges of LAS files; ranges of x, y and z in filters skip rows before they are scaled.

    Spark accepts a reader of filters only if spark.sql.python.filterPushdown.enabled is set.
    """

    def __init__(self, path: str) -> None:
        self.box: dict[str, tuple[float, float]] = {}
        super().__init__(path, read_header, lambda h, a, b: _rows(h, a, b, self.box))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 and f.attribute[0] in "xyz":
                low, high = self.box.get(f.attribute[0], (-np.inf, np.inf))
                above = isinstance(f, (GreaterThan, GreaterThanOrEqual))
                self.box[f.attribute[0]] = (max(low, f.value), high) if above else (low, min(high, f.value))
            yield f  # Spark tests all filters again, exactly


class LasSource(DataSource):
    """``spark.read.format("las")`` and ``df.write.format("las")``."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        path = self.options["path"]
        return LasFilterReader(path) if self.options.get("pushdown") == "true" else RangeReader(path, read_header, _rows)

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        o = self.options
        numbers = lambda key: [float(v) for v in o[key].split(",")]
        kind, scale, shift = int(o.get("point_format", 3)), np.array(numbers("scale")), np.array(numbers("offset"))
        low, high, crs = numbers("low"), numbers("high"), o.get("crs", "")
        date = datetime.fromisoformat(o["date"]) if o.get("date") else datetime(1970, 1, 1)
        layout = np.dtype(FORMATS[kind])

        def encode(batch: pa.RecordBatch) -> bytes:
            out = np.zeros(batch.num_rows, layout)
            col = {n: batch.column(n).fill_null(0 if not pa.types.is_boolean(batch.schema.field(n).type) else False).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            get = lambda n: col.get(n, np.zeros(batch.num_rows)).astype(np.int64)
            for i, (a, r) in enumerate(zip("xyz", "XYZ")):
                out[r] = np.round((col[a] - shift[i]) / scale[i])
            out["flags"] = (get("return_num") & 7) | (get("num_returns") & 7) << 3 | get("scan_direction_flag") << 6 | get("edge_of_flight_line") << 7
            out["class"] = (get("classification") & 31) | get("synthetic") << 5 | get("keypoint") << 6 | get("withheld") << 7
            for n in layout.names:
                if n not in ("X", "Y", "Z", "flags", "class", "wave") and n in col:
                    out[n] = col[n]
            return out.tobytes()

        def header(count: int) -> bytes:
            text = crs.encode() + b"\0" if crs else b""
            vlr = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 2112, len(text), b"coordinate system") + text if crs else b""
            head = bytearray(227)
            head[0:4] = b"LASF"
            head[24:26] = bytes((1, 2))
            struct.pack_into("<32s32sHHHIIBHI", head, 26, b"OTHER", b"fieldloom", date.timetuple().tm_yday, date.year, 227, 227 + len(vlr), int(bool(vlr)), kind, layout.itemsize, count)
            struct.pack_into("<3d3d", head, 131, *scale, *shift)
            struct.pack_into("<6d", head, 179, high[0], low[0], high[1], low[1], high[2], low[2])
            return bytes(head) + vlr

        return OneFileWriter(o["path"], encode, header, overwrite)


def load_las(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file, folder or pattern; filters are pushed into the files where the session allows it."""
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return register(spark).read.format("las").option("pushdown", push).load(path)


def write_las(df: DataFrame, path: str, point_format: int = 3, crs: str | None = None, date: datetime | None = None, offset: tuple[float, float, float] | None = None) -> None:
    """Write records to one file: the scale follows from the largest distance to the offset.

    Rows of null coordinates cannot be written and raise ``ValueError``.
    """
    row = df.agg(*(f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("l", F.min), ("h", F.max))), F.count_if(F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()).alias("bad")).first()
    if row["bad"]:
        raise ValueError("rows without coordinates")
    low, high = ([row[n + a] if row[n + a] is not None else 0.0 for a in "xyz"] for n in "lh")
    offset = tuple(offset) if offset is not None else tuple(low)
    scale = [max(max(abs(lo - o), abs(hi - o)) / 2**28, 1e-12) for lo, hi, o in zip(low, high, offset)]
    text = lambda v: ",".join(repr(float(x)) for x in v)
    columns = [c for c in df.columns if c in re.findall(r"(\w+) (?:double|int|smallint|tinyint|boolean)", SCHEMA)]
    save(df.select(*columns), "las", path, point_format=point_format, scale=text(scale), offset=text(offset), low=text(low), high=text(high), crs=crs or "", date=date.isoformat() if date else "")
