"""Relational operations on record tables, and predicates of laser records."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, columns: Mapping[str, Sequence], schema: T.StructType | str | None = None) -> DataFrame:
    """A table from a mapping of equally long columns. Two-dimensional arrays become array columns."""
    sizes = {len(v) for v in columns.values()}
    if len(sizes) > 1:
        raise ValueError("columns of different lengths")
    arrow = pa.table({k: pa.array(v.tolist() if isinstance(v, np.ndarray) and v.ndim > 1 else v) for k, v in columns.items()})
    df = spark.createDataFrame(arrow)
    return df if schema is None else df.to(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def add_fields(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Append columns. Raises ``ValueError`` if a name is taken."""
    taken = [c for c in columns if c.lower() in {n.lower() for n in df.columns}]
    if taken:
        raise ValueError(f"columns exist: {taken}")
    return df.withColumns(dict(columns))


def fuse(left: DataFrame, right: DataFrame, id: str = "id") -> DataFrame:
    """Columns of two tables side by side, row by row by id; names must differ."""
    clash = (set(left.columns) & set(right.columns)) - {id}
    if clash:
        raise ValueError(f"columns in both: {sorted(clash)}")
    return left.join(right, id)


def merge(*frames: DataFrame) -> DataFrame:
    """All rows of tables of the same names and types. Raises ``ValueError`` otherwise."""
    first = {f.name: f.dataType for f in frames[0].schema.fields}
    out = frames[0]
    for df in frames[1:]:
        if {f.name: f.dataType for f in df.schema.fields} != first:
            raise ValueError("tables of different columns or types")
        out = out.unionByName(df)
    return out


def stack(axis: str, **frames: DataFrame) -> DataFrame:
    """All rows, with the name of the table they come from in a new column ``axis``."""
    return merge(*(df.withColumn(axis, F.lit(name)) for name, df in frames.items()))


def subset(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns in the order asked for. Raises ``ValueError`` for unknown ones."""
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    return df.select(*names)


def field_list(schema: T.StructType, prefix: str = "") -> list[tuple[str, str]]:
    """(name, type) of every leaf, nested names joined by dots."""
    out = []
    for f in schema.fields:
        name = prefix + f.name
        if isinstance(f.dataType, T.StructType):
            out += field_list(f.dataType, name + ".")
        else:
            out.append((name, f.dataType.simpleString()))
    return out


def unnest(df: DataFrame, deep: bool = False, widths: Mapping[str, int] | None = None) -> DataFrame:
    """Struct fields as columns of their own, at any depth if ``deep``; arrays too, as ``name.1``..., where their width is given."""
    columns = []

    def walk(path: str, name: str, kind: T.DataType, level: int) -> None:
        if isinstance(kind, T.StructType) and (level == 0 or deep):
            for f in kind.fields:
                walk(f"{path}.`{f.name}`", f"{name}.{f.name}" if level or True else f.name, f.dataType, level + 1)
        elif isinstance(kind, T.ArrayType) and widths and name in widths:
            columns.extend(F.col(path)[i].alias(f"{name}.{i + 1}") for i in range(widths[name]))
        else:
            columns.append(F.col(path).alias(name))

    for f in df.schema.fields:
        walk(f"`{f.name}`", f.name, f.dataType, 0)
    return df.select(*columns)


def split_array(array: str, width: int, names: Sequence[str] | None = None) -> list[Column]:
    """The elements of an array column as columns."""
    return [F.col(array)[i].alias(names[i] if names else f"{array}_{i + 1}") for i in range(width)]


def apply_rows(df: DataFrame, function: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """A vectorised function of Arrow tables over all rows, with its declared result."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            yield from function(pa.Table.from_batches([batch])).to_batches()

    return df.mapInArrow(run, schema)


def keys_of(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    """Every key of a shape, one row each: key_0, key_1, ..."""
    total = int(np.prod(shape))
    df = spark.range(total).withColumnRenamed("id", "_i")
    out, rest = [], F.col("_i")
    for axis in range(len(shape) - 1, -1, -1):
        out.append(F.pmod(rest, F.lit(shape[axis])).cast("int").alias(f"key_{axis}"))
        rest = F.floor(rest / shape[axis])
    return df.select(*reversed(out))


def range_filter(df: DataFrame, column: str, low: float = float("-inf"), high: float = float("inf")) -> DataFrame:
    """Rows whose value lies in the closed range; nulls do not."""
    return df.where(F.col(column).between(low, high))


def array_range_filter(df: DataFrame, column: str, low: float, high: float, id: str = "id") -> DataFrame:
    """(id, position) of the array elements in the closed range."""
    return df.select(id, F.posexplode(column).alias("position", "_v")).where(F.col("_v").between(low, high)).select(id, "position")


def missing(column: str, kind: T.DataType) -> Column:
    """Null, NaN or the string nan."""
    value = F.col(column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    if isinstance(kind, T.StringType):
        return value.isNull() | (value == "nan")
    return value.isNull()


# Ranges of whole-number types, smallest first.
RANGES = {"tinyint": (-(2**7), 2**7 - 1), "smallint": (-(2**15), 2**15 - 1), "int": (-(2**31), 2**31 - 1), "bigint": (-(2**63), 2**63 - 1)}


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_array(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType)


def has_keys(df: DataFrame) -> bool:
    """Whether columns are told by name; tables always have names, so whether there are any."""
    return bool(df.columns)


def value_range(kind: str) -> tuple[int, int]:
    """Smallest and largest value of a whole-number type. Raises ``ValueError`` for others."""
    if kind not in RANGES:
        raise ValueError(f"{kind} is no whole-number type")
    return RANGES[kind]


def smallest_type(df: DataFrame, column: str) -> str:
    """Smallest type that holds all values of a column, from one aggregate; floating columns stay."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return kind.simpleString()
    row = df.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    if row["a"] is None:
        return "tinyint"
    return next(name for name, (lo, hi) in RANGES.items() if lo <= row["a"] and row["b"] <= hi)


# Fields of laser records.
LAS_FIELDS = {
    "intensity": "int", "classification": "smallint", "user_data": "smallint", "return_num": "smallint", "num_returns": "smallint", "synthetic": "boolean",
    "keypoint": "boolean", "withheld": "boolean", "scan_direction_flag": "boolean", "edge_of_flight_line": "boolean", "pt_src_id": "int", "gps_time": "double",
    "scan_angle_rank": "tinyint", "red": "int", "green": "int", "blue": "int", "nir": "int",
}


def first_return() -> Column:
    return F.col("return_num") == 1


def last_return() -> Column:
    return F.col("return_num") == F.col("num_returns")


def only_return() -> Column:
    return F.col("num_returns") == 1


def of_classes(*classes: int) -> Column:
    return F.col("classification").isin(*classes)


def ground() -> Column:
    return of_classes(2)


def vegetation() -> Column:
    return of_classes(3, 4, 5)


def total_gps_seconds(date: Column) -> Column:
    """Seconds since the first ISO week of the year of ``date``; null without a date."""
    return F.weekofyear(date) * 604800 + F.col("gps_time")


def activate(df: DataFrame, name: str) -> DataFrame:
    """Add a known laser field, 0 or false, if it is not there. Raises ``ValueError`` for unknown fields."""
    if name not in LAS_FIELDS:
        raise ValueError(f"{name} is not a laser field")
    return df if name in df.columns else df.withColumn(name, F.lit(0).cast(LAS_FIELDS[name]))
