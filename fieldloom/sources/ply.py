"""PLY files: the vertex element, ascii or binary of either byte order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter

from fieldloom.sources.base import Header, OneFileWriter, RangeReader, paths_of, register, save

# Names of types in headers.
_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4",
    "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
_SPARK = {"i1": "tinyint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "f4": "float", "f8": "double"}
_ARROW = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}
_PLY = {"tinyint": ("char", "i1"), "smallint": ("short", "i2"), "int": ("int", "i4"), "bigint": ("double", "f8"), "float": ("float", "f4"), "double": ("double", "f8"), "boolean": ("uchar", "u1")}


def read_header(path: str) -> Header:
    """Count and fields of the vertex element. List properties of it are not supported."""
    with open(path, "rb") as file:
        if file.readline().strip() != b"ply":
            raise ValueError(f"{path} is not a PLY file")
        kind, elements = "", []
        while (line := file.readline()) and line.strip() != b"end_header":
            words = line.decode("ascii", "replace").split()
            if words[:1] == ["format"]:
                kind = words[1]
            elif words[:1] == ["element"]:
                elements.append((words[1], int(words[2]), []))
            elif words[:1] == ["property"]:
                elements[-1][2].append((words[-1], words[1], words[2] if words[1] == "list" else None))
        start = file.tell()
    if not elements or elements[0][0] != "vertex":
        raise ValueError("the vertex element must come first")
    _, count, properties = elements[0]
    if any(p[1] == "list" for p in properties):
        raise ValueError("vertices with lists are not supported")
    fields = [(n.removeprefix("scalar_"), _TYPES[t]) for n, t, _ in properties]
    return Header(path, count, more={"kind": kind, "start": start, "fields": fields})


def _names(fields: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Result columns: the first three fields are x, y and z."""
    return [("xyz"[i] if i < 3 else n, "double" if i < 3 else _SPARK[t]) for i, (n, t) in enumerate(fields)]


def _rows(header: Header, start: int, end: int) -> Iterator[pa.RecordBatch]:
    fields = header.more["fields"]
    order = {"binary_little_endian": "<", "binary_big_endian": ">"}.get(header.more["kind"])
    with open(header.path, "rb") as file:
        file.seek(header.more["start"])
        if order is None:
            for _ in range(start):
                file.readline()
            text = [file.readline().split() for _ in range(end - start)]
            columns = [np.array([row[i] for row in text]).astype(t) for i, (_, t) in enumerate(fields)]
        else:
            layout = np.dtype([(f"f{i}", order + t) for i, (_, t) in enumerate(fields)])
            file.seek(header.more["start"] + start * layout.itemsize)
            rec = np.frombuffer(file.read((end - start) * layout.itemsize), layout)
            columns = [rec[f"f{i}"].astype(t) for i, (_, t) in enumerate(fields)]
    arrays = [pa.array(c).cast(_ARROW[kind]) for c, (_, kind) in zip(columns, _names(fields))]
    yield pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in _names(fields)])


class PlySource(DataSource):
    """``spark.read.format("ply")`` and ``df.write.format("ply")``."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return ", ".join(f"`{n}` {t}" for n, t in _names(read_header(paths_of(self.options["path"])[0]).more["fields"]))

    def reader(self, schema: object) -> DataSourceReader:
        return RangeReader(self.options["path"], read_header, _rows)

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        kinds = [(f.name, *_PLY[f.dataType.simpleString()]) for f in schema.fields]
        layout = np.dtype([(n, "<" + t) for n, _, t in kinds])

        def encode(batch: pa.RecordBatch) -> bytes:
            out = np.zeros(batch.num_rows, layout)
            for n, _, _ in kinds:
                out[n] = batch.column(n).to_numpy(zero_copy_only=False)
            return out.tobytes()

        def header(count: int) -> bytes:
            lines = ["ply", "format binary_little_endian 1.0", f"element vertex {count}", *(f"property {p} {n}" for n, p, _ in kinds), "end_header", ""]
            return "\n".join(lines).encode()

        return OneFileWriter(self.options["path"], encode, header, overwrite)


def load_ply(spark: SparkSession, path: str) -> DataFrame:
    return register(spark).read.format("ply").load(path)


def write_ply(df: DataFrame, path: str) -> None:
    """Write x, y, z and scalar columns; 64-bit whole numbers become doubles, as the format has none."""
    rest = [c for c in df.columns if c not in "xyz"]
    save(df.select("x", "y", "z", *rest), "ply", path)
