"""What the readers of binary formats share: headers without rows, row ranges as partitions, and one-file commits."""

from __future__ import annotations

import glob
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from fieldloom.operators.frame import Extent

#: Rows per input partition of the binary readers.
ROWS = 1_000_000


@dataclass
class Header:
    """What a file says about itself before any row is read."""

    path: str
    count: int
    t: np.ndarray | None = None
    extent: Extent | None = None
    crs: str | None = None
    date: datetime | None = None
    more: dict = field(default_factory=dict)

    def __len__(self) -> int:
        return self.count

    @property
    def corners(self) -> np.ndarray | None:
        return None if self.extent is None else self.extent.corners


def paths_of(path: str) -> list[str]:
    """Files of a path, a folder or a pattern, in order."""
    path = path.removeprefix("file://").removeprefix("file:")
    found = sorted(p for p in glob.glob(os.path.join(path, "*")) if os.path.isfile(p)) if os.path.isdir(path) else sorted(glob.glob(path)) or [path]
    return [p for p in found if not os.path.basename(p).startswith(("_", "."))]


class Range(InputPartition):
    """Rows from start to end of one file."""

    def __init__(self, path: str, start: int, end: int) -> None:
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class RangeReader(DataSourceReader):
    """Reads files by row ranges; ``header`` gives the count, ``rows`` the Arrow batches of a range."""

    def __init__(self, path: str, header: Callable[[str], Header], rows: Callable[[Header, int, int], Iterator[pa.RecordBatch]], step: int = ROWS) -> None:
        self.path, self.header, self.rows, self.step = path, header, rows, step

    def partitions(self) -> list[Range]:
        out = []
        for path in paths_of(self.path):
            count = self.header(path).count
            out += [Range(path, at, min(at + self.step, count)) for at in range(0, count, self.step)]
        return out or [Range(self.path, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.end > partition.start:
            yield from self.rows(self.header(partition.path), partition.start, partition.end)


@dataclass
class Part(WriterCommitMessage):
    """A piece of the output, written by one task next to the target."""

    path: str
    rows: int


class OneFileWriter(DataSourceArrowWriter):
    """Tasks write pieces of rows; the commit puts a header and the pieces together."""

    def __init__(self, path: str, encode: Callable[[pa.RecordBatch], bytes], header: Callable[[int], bytes], overwrite: bool) -> None:
        self.path = path.removeprefix("file://").removeprefix("file:")
        self.encode, self.header, self.overwrite = encode, header, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        path, rows = f"{self.path}.part-{uuid.uuid4().hex}", 0
        with open(path, "wb") as out:
            for batch in iterator:
                out.write(self.encode(batch))
                rows += batch.num_rows
        return Part(path, rows)

    def commit(self, messages: list[Part | None]) -> None:
        parts = [m for m in messages if m is not None]
        if os.path.exists(self.path) and not self.overwrite:
            raise FileExistsError(self.path)
        with open(self.path + ".tmp", "wb") as out:
            out.write(self.header(sum(p.rows for p in parts)))
            for p in parts:
                with open(p.path, "rb") as piece:
                    shutil.copyfileobj(piece, out)
        os.replace(self.path + ".tmp", self.path)
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


def register(spark: SparkSession) -> SparkSession:
    """Make the formats las, ply and geotiff known to a session."""
    from fieldloom.sources.las import LasSource  # noqa: PLC0415
    from fieldloom.sources.ply import PlySource  # noqa: PLC0415
    from fieldloom.sources.tiff import TiffSource  # noqa: PLC0415

    for source in (LasSource, PlySource, TiffSource):
        spark.dataSource.register(source)
    return spark


def save(df: DataFrame, kind: str, path: str, **options: object) -> None:
    """Write a table by one of the registered formats."""
    register(df.sparkSession)
    writer = df.write.format(kind).mode("overwrite")
    for key, value in options.items():
        writer = writer.option(key, str(value))
    writer.save(path)


class GeoFile:
    """A file known by its header, of which the rows, or those in an extent, are loaded when asked for.

    The suffix tells the format: las, ply, tif or tiff.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        from fieldloom.sources import las, ply, tiff  # noqa: PLC0415

        self.spark, self.path = spark, path
        suffix = path.rpartition(".")[2].lower()
        kinds = {"las": (las.read_header, las.load_las), "ply": (ply.read_header, ply.load_ply), "tif": (tiff.read_header, tiff.load_raster), "tiff": (tiff.read_header, tiff.load_raster)}
        if suffix not in kinds:
            raise ValueError(f"no format for .{suffix}")
        head, self._load = kinds[suffix]
        self.raster = suffix.startswith("tif")
        self.header = head(path.removeprefix("file://"))
        self._rows: DataFrame | None = None

    def __len__(self) -> int:
        return len(self.header)

    @property
    def extent(self) -> Extent | None:
        return self.header.extent

    @property
    def crs(self) -> str | None:
        return self.header.crs

    def load(self, extent: Extent | None = None) -> DataFrame:
        """Rows of the file; of an extent, those within it (closed), with filters that the reader may take."""
        if self._rows is None:
            self._rows = self._load(self.spark, self.path)
        if self.raster:
            return (self._rows if extent is None else self._rows.window(extent)).df
        return self._rows if extent is None else self._rows.where(extent.contains(["x", "y", "z"][: extent.dim]))

    def clean_cache(self) -> None:
        """Forget the rows; the next load reads the header's file again."""
        if self._rows is not None and not self.raster:
            self._rows.unpersist()
        self._rows = None
