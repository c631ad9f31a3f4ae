"""CSV, JSON and whole frames on disk, synthetic records, and the mapping of types."""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.operators.frame import PointFrame


def load_csv(spark: SparkSession, path: str, sep: str = ",", mark: str = ".", schema: str | None = None, ignore: str = "# ") -> DataFrame:
    """A CSV file with a header; columns ``a.1`` to ``a.k`` become one array column ``a``.

    A header prefix like ``# `` is taken off. Types come from ``schema`` (for the
    flat columns, in order) or are inferred. Lines that do not parse give nulls;
    ``fieldloom.operators.badrows`` separates them with the reason.
    """
    reader = spark.read.option("sep", sep).option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("nanValue", "nan")
    flat = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    names = [n.removeprefix("﻿").removeprefix(ignore).strip() for n in flat.columns]
    flat = flat.toDF(*names)
    groups: dict[str, list[tuple[int, str]]] = {}
    for n in names:
        found = re.fullmatch(rf"(.+){re.escape(mark)}(\d+)", n)
        groups.setdefault(found[1] if found else n, []).append((int(found[2]) if found else 0, n))
    out = []
    for name, parts in groups.items():
        parts.sort()
        out.append(F.array(*(F.col(f"`{p}`") for _, p in parts)).alias(name) if parts[0][0] else F.col(f"`{name}`"))
    return flat.select(*out)


def write_csv(df: DataFrame, path: str, sep: str = ",", mark: str = ".", widths: dict[str, int] | None = None) -> None:
    """Write a CSV folder; array columns of known width become ``a.1`` to ``a.k``, the first name is prefixed by ``# ``."""
    columns = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            columns += [F.col(f"`{f.name}`")[i].alias(f"{f.name}{mark}{i + 1}") for i in range((widths or {})[f.name])]
        else:
            columns.append(F.col(f"`{f.name}`"))
    flat = df.select(*columns)
    flat.toDF("# " + flat.columns[0], *flat.columns[1:]).write.mode("overwrite").option("sep", sep).option("header", True).option("nanValue", "nan").csv(path)


def load_json(spark: SparkSession, path: str, schema: str | None = None, whole: bool = False) -> DataFrame:
    """JSON lines, or one document per file if ``whole``."""
    reader = spark.read.option("multiLine", whole)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def dump(frame: PointFrame, path: str) -> None:
    """A frame as Parquet, with what is known about it beside the rows. No code is stored or run."""
    frame.df.write.mode("overwrite").parquet(f"{path}/rows")
    about = {"axes": frame.axes, "id": frame.id, "crs": frame.crs, "t": None if frame.t is None else np.asarray(frame.t).tolist(), "date": frame.date.isoformat() if frame.date else None}
    frame.df.sparkSession.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_dump(spark: SparkSession, path: str) -> PointFrame:
    """The inverse of ``dump``."""
    from datetime import datetime  # noqa: PLC0415

    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    return PointFrame(spark.read.parquet(f"{path}/rows"), tuple(about["axes"]), about["id"], about["crs"], None if about["t"] is None else np.array(about["t"]), datetime.fromisoformat(about["date"]) if about["date"] else None)


def random_records(spark: SparkSession, n: int = 1000, center: tuple[float, float, float] = (0.0, 0.0, 0.0), scale: float = 10.0, seed: int = 1, crs: str = "EPSG:25832") -> PointFrame:
    """A synthetic cloud: uniform coordinates, classes by height, flags on the first rows; the same for the same seed."""
    u = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "id"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    df = spark.range(n)
    up = u(2) * scale
    df = df.select(
        "id", *((u(i) * scale + center[i]).alias(a) for i, a in enumerate("xyz")), F.floor(u(3) * 255).cast("int").alias("intensity"),
        F.when(up > 5, 5).when(up > 3, 4).when(up > 1, 3).otherwise(2).cast("smallint").alias("classification"), F.col("id").cast("double").alias("values"),
        (F.col("id") == 2).alias("keypoint"), (F.col("id") == 1).alias("synthetic"), (F.col("id") == 3).alias("withheld"),
    )
    return PointFrame(df, ("x", "y", "z"), "id", crs)


# Codes of whole-number and floating types in extra LAS dimensions and in rasters.
LAS_CODES = {"smallint": 4, "int": 6, "bigint": 8, "float": 9, "double": 10, "tinyint": 2}
RASTER_CODES = {"tinyint": (2, 8), "smallint": (2, 16), "int": (2, 32), "float": (3, 32), "double": (3, 64)}


def las_code(kind: T.DataType) -> int:
    """Code of a type in LAS extra dimensions. Raises ``ValueError`` for types it does not have."""
    try:
        return LAS_CODES[kind.simpleString()]
    except KeyError:
        raise ValueError(f"no LAS type for {kind.simpleString()}") from None


def raster_code(kind: T.DataType) -> tuple[int, int]:
    """(sample format, bits) of a type in rasters. Raises ``ValueError`` for types it does not have."""
    try:
        return RASTER_CODES[kind.simpleString()]
    except KeyError:
        raise ValueError(f"no raster type for {kind.simpleString()}") from None
