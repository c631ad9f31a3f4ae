"""Uncompressed GeoTIFF rasters in strips."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter

from fieldloom.functions import affine
from fieldloom.operators.frame import Extent
from fieldloom.operators.grid import Grid
from fieldloom.sources.base import Header, OneFileWriter, Range, RangeReader, register, save

# Sizes and struct codes of tag types, and numpy types by (format, bits).
_KINDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
#: Compression codes of zlib streams.
DEFLATE = (8, 32946)
_DTYPES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
SCHEMA = "key_0 int, key_1 int, bands array<double>"


def read_header(path: str) -> Header:
    """Shape, bands, matrix, system and date of a raster; ``count`` is its number of rows of cells."""
    with open(path, "rb") as file:
        order = {b"II": "<", b"MM": ">"}.get(file.read(2))
        if order is None or struct.unpack(order + "H", file.read(2))[0] != 42:
            raise ValueError(f"{path} is not a TIFF file")
        file.seek(struct.unpack(order + "I", file.read(4))[0])
        n = struct.unpack(order + "H", file.read(2))[0]
        tags: dict[int, list] = {}
        for entry in [file.read(12) for _ in range(n)]:
            tag, kind, count = struct.unpack(order + "HHI", entry[:8])
            if kind not in _KINDS:
                continue
            size, code = _KINDS[kind]
            raw = entry[8:12]
            if size * count > 4:
                file.seek(struct.unpack(order + "I", raw)[0])
                raw = file.read(size * count)
            tags[tag] = [raw[:count].rstrip(b"\0").decode("ascii", "replace")] if kind == 2 else list(struct.unpack(order + code * count, raw[: size * count]))
    one = lambda tag, default: tags.get(tag, [default])[0]
    if one(259, 1) not in (1, *DEFLATE):
        raise ValueError(f"compression {one(259, 1)} is not supported")
    if one(317, 1) not in (1, 2):
        raise ValueError(f"predictor {one(317, 1)} is not supported")
    width, height, bands = one(256, 0), one(257, 0), one(277, 1)
    dtype = _DTYPES.get((one(339, 1), one(258, 1)))
    if dtype is None:
        raise ValueError("unknown sample format")
    if 34264 in tags:
        m = tags[34264]
        t = np.array([[m[0], m[1], m[3]], [m[4], m[5], m[7]], [0, 0, 1]])
    elif 33550 in tags and 33922 in tags:
        s, p = tags[33550], tags[33922]
        t = affine.compose(t=[p[3] - p[0] * s[0], p[4] + p[1] * s[1]], s=[s[0], -s[1]])
    else:
        t = np.eye(3)
    keys = tags.get(34735, [])
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    code = codes.get(3072) or codes.get(2048)
    date = None
    if 306 in tags:
        try:
            date = datetime.strptime(tags[306][0], "%Y:%m:%d %H:%M:%S")
        except ValueError:
            date = None
    corners = affine.transform_to_corners(t, (height, width))
    more = {"width": width, "bands": bands, "dtype": order + dtype, "planar": one(284, 1) == 2, "packed": one(259, 1) != 1, "predictor": one(317, 1)}
    if 324 in tags:
        more |= {"strips": tags[324], "sizes": tags.get(325, []), "per": one(323, height), "wide": one(322, width), "tiled": True}
    else:
        more |= {"strips": tags[273], "sizes": tags.get(279, []), "per": min(one(278, height), height), "wide": width, "tiled": False}
    return Header(path, height, t, Extent(tuple(corners.min(axis=0)), tuple(corners.max(axis=0))), f"EPSG:{code}" if code else None, date, more)


def _cells(row: int, cells: np.ndarray) -> pa.RecordBatch:
    width, bands = cells.shape
    offsets = pa.array(np.arange(0, (width + 1) * bands, bands, dtype=np.int32))
    return pa.RecordBatch.from_arrays([pa.array(np.full(width, row, np.int32)), pa.array(np.arange(width, dtype=np.int32)), pa.ListArray.from_arrays(offsets, pa.array(cells.astype(float).ravel()))], names=["key_0", "key_1", "bands"])


def _blocks(header: Header, start: int, end: int) -> Iterator[pa.RecordBatch]:
    """Rows of a tiled or compressed raster: the blocks of a band of rows are read and put side by side."""
    m = header.more
    dtype, bands, tall, wide = np.dtype(m["dtype"]), m["bands"], m["per"], m["wide"]
    across, down = -(-m["width"] // wide), -(-header.count // tall)
    planes, deep = (bands, 1) if m["planar"] else (1, bands)
    with open(header.path, "rb") as file:
        for band in range(start // tall, (end - 1) // tall + 1):
            # The last strip ends with the raster; tiles are always whole.
            lines = tall if m["tiled"] else min(tall, header.count - band * tall)
            whole = np.empty((lines, across * wide, bands))
            for plane in range(planes):
                for column in range(across):
                    at = (plane * down + band) * across + column
                    file.seek(m["strips"][at])
                    raw = file.read(m["sizes"][at] if at < len(m["sizes"]) else lines * wide * deep * dtype.itemsize)
                    if m["packed"]:
                        raw = zlib.decompress(raw)
                    block = np.frombuffer(raw[: lines * wide * deep * dtype.itemsize], dtype).reshape(lines, wide, deep)
                    if m["predictor"] == 2:  # differences along the row, which wrap around
                        block = np.cumsum(block, axis=1, dtype=dtype.newbyteorder("="))
                    whole[:, column * wide:(column + 1) * wide, plane:plane + deep] = block
            for row in range(max(start, band * tall), min(end, band * tall + lines)):
                yield _cells(row, whole[row - band * tall, : m["width"]])


def _rows(header: Header, start: int, end: int) -> Iterator[pa.RecordBatch]:
    m = header.more
    if m["tiled"] or m["packed"] or m["predictor"] == 2:
        yield from _blocks(header, start, end)
        return
    width, bands, dtype = m["width"], m["bands"], np.dtype(m["dtype"])
    per_plane = -(-header.count // m["per"])
    with open(header.path, "rb") as file:
        for row in range(start, end):
            strip, line = divmod(row, m["per"])
            if m["planar"]:
                cells = np.empty((width, bands))
                for b in range(bands):
                    file.seek(m["strips"][b * per_plane + strip] + line * width * dtype.itemsize)
                    cells[:, b] = np.frombuffer(file.read(width * dtype.itemsize), dtype)
            else:
                file.seek(m["strips"][strip] + line * width * bands * dtype.itemsize)
                cells = np.frombuffer(file.read(width * bands * dtype.itemsize), dtype).reshape(width, bands).astype(float)
            yield _cells(row, cells)


class RowReader(RangeReader):
    """Row ranges of cells, of which only those from ``low`` to ``high`` are read."""

    def __init__(self, path: str, low: int, high: int) -> None:
        super().__init__(path, read_header, _rows, step=512)
        self.low, self.high = low, high

    def partitions(self) -> list[Range]:
        cut = [Range(p.path, max(p.start, self.low), min(p.end, self.high)) for p in super().partitions()]
        return [p for p in cut if p.start < p.end] or [Range(self.path, 0, 0)]


class TiffSource(DataSource):
    """``spark.read.format("geotiff")``: one row per cell; rows of cells are the partitions."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return RowReader(self.options["path"], int(self.options.get("low") or 0), int(self.options.get("high") or 1 << 31))

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        o = self.options
        height, width, bands = int(o["height"]), int(o["width"]), int(o["bands"])
        t = np.array([float(v) for v in o["t"].split(",")]).reshape(3, 3)
        epsg = int(o.get("epsg") or 0)

        def encode(batch: pa.RecordBatch) -> bytes:
            return batch.column("bands").flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes()

        def header(count: int) -> bytes:
            if count != height * width:
                raise ValueError(f"{count} cells for a raster of {height} x {width}")
            line = width * bands * 8
            matrix = [t[0, 0], t[0, 1], 0, t[0, 2], t[1, 0], t[1, 1], 0, t[1, 2], 0, 0, 0, 0, 0, 0, 0, 1]
            geo = [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, epsg] if epsg else None
            entries: list[tuple[int, int, list]] = [
                (256, 4, [width]), (257, 4, [height]), (258, 3, [64] * bands), (259, 3, [1]), (262, 3, [1]), (273, 4, [0] * height), (277, 3, [bands]), (278, 4, [1]),
                (279, 4, [line] * height), (284, 3, [1]), (339, 3, [3] * bands), (34264, 12, matrix),
            ]
            if geo:
                entries.append((34735, 3, geo))
            size = lambda e: _KINDS[e[1]][0] * len(e[2])
            at = 8 + 2 + 12 * len(entries) + 4
            places = []
            for e in entries:
                places.append(at if size(e) > 4 else 0)
                at += size(e) + size(e) % 2 if size(e) > 4 else 0
            if at + line * height >= 1 << 32:
                raise ValueError("the raster is larger than a classic TIFF file can be")
            entries[5] = (273, 4, [at + i * line for i in range(height)])
            out, tail = [b"II", struct.pack("<HIH", 42, 8, len(entries))], []
            for (tag, kind, values), place in zip(entries, places):
                raw = struct.pack("<" + _KINDS[kind][1] * len(values), *values)
                out.append(struct.pack("<HHI", tag, kind, len(values)) + (struct.pack("<I", place) if place else raw.ljust(4, b"\0")))
                if place:
                    tail.append(raw + b"\0" * (len(raw) % 2))
            return b"".join([*out, b"\0\0\0\0", *tail])

        return OneFileWriter(o["path"], encode, header, overwrite)


def load_raster(spark: SparkSession, path: str, extent: Extent | None = None) -> Grid:
    """A raster as a grid with a ``bands`` array per cell, or the part of it that an extent covers."""
    head = read_header(path)
    low, high = 0, head.count
    if extent is not None:
        keys = affine.grid_keys(head.t, extent.corners)[:, 0]
        low, high = max(0, int(keys.min())), max(0, int(keys.max()))
    rows = register(spark).read.format("geotiff").option("low", low).option("high", high).load(path)
    grid = Grid(rows, head.t, (head.count, head.more["width"]), head.crs)
    return grid if extent is None else grid.window(extent)


def write_raster(grid: Grid, path: str, fields: Sequence[str] = ("bands",), no_data: float | None = None) -> None:
    """One raster from an array column, or one band per scalar column, as 64-bit numbers.

    Cells that the grid does not have, and nulls, get ``no_data`` (NaN without
    one). The cells are sorted by ranges of keys, one task per range.
    """
    from fieldloom.operators.records import keys_of  # noqa: PLC0415

    if grid.dim != 2:
        raise ValueError("rasters have two dimensions")
    fill = float("nan") if no_data is None else float(no_data)
    kinds = dict(grid.df.dtypes)
    if len(fields) == 1 and kinds[fields[0]].startswith("array"):
        bands = grid.df.select(F.max(F.size(fields[0])).alias("n")).first()["n"] or 1
        values = [F.get(F.col(fields[0]), F.lit(i)) for i in range(bands)]
    else:
        bands, values = len(fields), [F.col(f) for f in fields]
    dense = keys_of(grid.df.sparkSession, grid.shape).join(grid.df, ["key_0", "key_1"], "left")
    cells = dense.select("key_0", "key_1", F.array(*(F.coalesce(v.cast("double"), F.lit(fill)) for v in values)).alias("bands"))
    ordered = cells.repartitionByRange("key_0", "key_1").sortWithinPartitions("key_0", "key_1")
    epsg = "".join(c for c in (grid.crs or "").rpartition(":")[2] if c.isdigit())
    save(ordered, "geotiff", path, height=grid.shape[0], width=grid.shape[1], bands=bands, t=",".join(repr(float(v)) for v in grid.t.ravel()), epsg=epsg)
