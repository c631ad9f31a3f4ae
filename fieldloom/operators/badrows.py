"""Load delimited lines in bulk and separate those that fail, with the reason.

The lines of one file (or of files with equal headers) in an Arrow batch form a
block. Lines whose quotes or number of separators cannot be those of a record are
told apart by columnar masks. The rest is split at once by the columnar CSV
reader; if that fails, it is halved until the failing lines stand alone. Values
of the blocks that were split are converted by column. Lines that the masks or
the halving single out, or whose values the columnar conversion does not take,
are diagnosed field by field, and loaded if nothing is wrong with them.
"""

from __future__ import annotations

import io
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.session import sized_join

# Whole-number columns with their largest value.
WHOLE = {"intensity": 65535, "classification": 255}
FINITE = re.compile(r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?")
DIGITS = re.compile(r"\+?[0-9]+|-0+")
#: Outer blanks of a field.
BLANKS = " \t"


class BadLine(ValueError):
    """A line that cannot be loaded; its text is the reason."""


def split_line(line: str, sep: str) -> list[str]:
    """Fields of one line under strict quoting. Raises ``BadLine('quoting')``."""
    if '"' not in line:
        return line.split(sep)
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            part, i = [], i + 1
            while True:
                end = line.find('"', i)
                if end < 0:
                    raise BadLine("quoting")
                part.append(line[i:end])
                if line[end + 1:end + 2] == '"':
                    part.append('"')
                    i = end + 2
                    continue
                i = end + 1
                break
            if i < n and line[i] != sep:
                raise BadLine("quoting")
            fields.append("".join(part))
        else:
            end = line.find(sep, i)
            end = n if end < 0 else end
            if '"' in line[i:end]:
                raise BadLine("quoting")
            fields.append(line[i:end])
            i = end
        if i >= n:
            return fields
        i += 1


def read_header(line: str | None, sep: str) -> list[str]:
    """Column names of a header line, without byte order mark, ``# ``, quotes and blanks."""
    text = (line or "").removeprefix("﻿").removesuffix("\r")
    text = text.removeprefix("#").lstrip(" ")
    try:
        return [f.strip() for f in split_line(text, sep)]
    except BadLine:
        return [f.strip().strip('"') for f in text.split(sep)]


def _missing(value: str) -> bool:
    return value == "" or value.lower() == "nan"


def diagnose(line: str, sep: str, names: list[str]) -> dict:
    """The record of one line (without its carriage return), or ``BadLine`` with the first reason that applies."""
    fields = split_line(line, sep)
    if len(fields) != len(names):
        raise BadLine("column_count")
    row: dict = {}
    for name, raw in zip(names, fields):
        value = raw.strip(BLANKS)
        if name.startswith("coords."):
            if not FINITE.fullmatch(value) or not math.isfinite(float(value)):
                raise BadLine("invalid_value")
            row[name] = float(value)
        elif name in WHOLE:
            if _missing(value):
                row[name] = None
            elif not DIGITS.fullmatch(value) or int(value) > WHOLE[name]:
                raise BadLine("invalid_value")
            else:
                row[name] = int(value)
        elif name == "values":
            if not _missing(value) and (not FINITE.fullmatch(value) or not math.isfinite(float(value))):
                raise BadLine("invalid_value")
            row[name] = None if _missing(value) else float(value)
        else:
            row[name] = raw
    return row


def _suspects(lines: pa.Array, sep: str, names: list[str], quoted: str) -> np.ndarray:
    """Lines whose quoting, number of separators outside quotes or line ends are not those of one record."""
    count, odd = pc.count_substring(lines, sep), pc.match_substring_regex(lines, r"[\r\n]")
    quotes = pc.match_substring(lines, '"')
    if pc.any(quotes).as_py():
        bare = pc.replace_substring_regex(lines, r'"(?:[^"]|"")*"', "")
        odd = pc.or_(odd, pc.and_(quotes, pc.invert(pc.match_substring_regex(lines, quoted))))
        count = pc.if_else(quotes, pc.count_substring(bare, sep), count)
    return pc.or_(odd, pc.not_equal(count, len(names) - 1)).to_numpy(zero_copy_only=False)


def _parse_block(lines: pa.Array, sep: str, names: list[str]) -> pa.Table | None:
    """Fields of the block as text columns by the bulk reader, or None if it fails on any line."""
    raw = ("\n".join(lines.to_pylist()) + "\n").encode()
    try:
        table = pyarrow.csv.read_csv(
            io.BytesIO(raw),
            read_options=pyarrow.csv.ReadOptions(column_names=names, use_threads=False, block_size=max(1 << 16, 2 * len(raw))),
            parse_options=pyarrow.csv.ParseOptions(delimiter=sep, quote_char='"', double_quote=True, newlines_in_values=False, ignore_empty_lines=False),
            convert_options=pyarrow.csv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), null_values=[], strings_can_be_null=False, check_utf8=False),
        )
    except (pa.ArrowInvalid, pa.ArrowKeyError):
        return None
    return table if table.num_rows == len(lines) else None


def _number(text: pa.ChunkedArray, fits: pa.ChunkedArray, kind: pa.DataType) -> pa.ChunkedArray:
    """Numbers of the texts that fit, nulls elsewhere."""
    return pc.if_else(fits, pc.utf8_ltrim(text, "+"), pa.scalar(None, pa.string())).cast(kind)


def _convert(table: pa.Table, names: list[str]) -> tuple[pa.Table, np.ndarray]:
    """Typed columns, and which rows are valid beyond doubt; the others are diagnosed strictly."""
    good = np.ones(table.num_rows, bool)
    out = {}
    for n in names:
        column = table[n]
        if not (n.startswith("coords.") or n == "values" or n in WHOLE):
            out[n] = column
            continue
        text = pc.utf8_trim(column, BLANKS)
        gone = pc.is_in(pc.utf8_lower(text), pa.array(["", "nan"]))
        if n in WHOLE:
            fits = pc.match_substring_regex(text, r"^\+?[0-9]{1,9}$")
            value = _number(text, fits, pa.int64())
            fits = pc.and_(fits, pc.fill_null(pc.less_equal(value, WHOLE[n]), False))
        else:
            fits = pc.match_substring_regex(text, rf"^{FINITE.pattern}$")
            value = _number(text, fits, pa.float64())
            fits = pc.and_(fits, pc.fill_null(pc.is_finite(value), False))
        ok = fits if n.startswith("coords.") else pc.or_(fits, gone)
        good &= ok.to_numpy(zero_copy_only=False) if isinstance(ok, pa.Array) else ok.to_numpy()
        out[n] = value
    return pa.table(out), good


def _strict(lines: pa.Array, at: np.ndarray, sep: str, names: list[str], good: list, bad: list) -> None:
    """Diagnose lines one by one."""
    rows, kept = [], []
    for k, line in zip(at, lines.to_pylist()):
        try:
            rows.append(diagnose(line, sep, names))
            kept.append(k)
        except BadLine as reason:
            bad.append((k, str(reason)))
    if rows:
        good.append((np.array(kept), pa.Table.from_pylist(rows)))


def _bisect(lines: pa.Array, at: np.ndarray, sep: str, names: list[str], good: list, bad: list) -> None:
    """Parse a block, or halve it until what fails is a single line."""
    if not len(lines):
        return
    table = _parse_block(lines, sep, names)
    if table is None and len(lines) > 1:
        half = len(lines) // 2
        _bisect(lines[:half], at[:half], sep, names, good, bad)
        _bisect(lines[half:], at[half:], sep, names, good, bad)
        return
    doubtful = np.ones(len(lines), bool)
    if table is not None:
        table, valid = _convert(table, names)
        good.append((at[valid], table.filter(pa.array(valid))))
        doubtful = ~valid
    _strict(lines.filter(pa.array(doubtful)), at[doubtful], sep, names, good, bad)


def _load(lines: pa.Array, at: np.ndarray, sep: str, names: list[str], quoted: str, good: list, bad: list) -> None:
    """Single out the lines that cannot be one record, and parse the others as a block."""
    odd = _suspects(lines, sep, names, quoted)
    _strict(lines.filter(pa.array(odd)), at[odd], sep, names, good, bad)
    _bisect(lines.filter(pa.array(~odd)), at[~odd], sep, names, good, bad)


RESULT = "file_id bigint, line_no int, reason string, x double, y double, z double, intensity int, classification int, value double, label string"


def load_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Every line after the header: as a record, or with the reason why it is none.

    Returns file_id, line_no, reason (null for records) and the record's fields;
    fields that a file does not have are null, as are those of failing lines.
    Reasons are quoting, column_count and invalid_value, the first that applies.
    A null line counts as an empty one. Lines of a file without a header line or
    without an entry in ``files`` (or with a null separator) fail with
    no_header. Repeated header names: the last one counts. Hot files need no
    care: blocks are cut from the stored order, and only headers are joined.
    """
    heads = lines.where("line_no = 1").groupBy("file_id").agg(F.min("line").alias("_head"))
    seps = files.groupBy("file_id").agg(F.min("sep").alias("_sep"))
    spec = heads.join(seps, "file_id", "left")
    body = sized_join(lines.where("line_no > 1").select("file_id", "line_no", "line"), spec, ["file_id"], "left", salt_by="line_no", width=256)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            yield from load_batch(table).to_batches()

    return body.select("file_id", "line_no", F.coalesce("line", F.lit("")).alias("line"), "_head", "_sep").mapInArrow(read, RESULT)


_SCHEMA = pa.schema([
    ("file_id", pa.int64()), ("line_no", pa.int32()), ("reason", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64()),
    ("intensity", pa.int32()), ("classification", pa.int32()), ("value", pa.float64()), ("label", pa.string()),
])
_FIELDS = {"coords.1": "x", "coords.2": "y", "coords.3": "z", "intensity": "intensity", "classification": "classification", "values": "value", "label": "label"}


def load_batch(table: pa.Table) -> pa.Table:
    """One Arrow table of lines with their headers, loaded block by block."""
    head, sep = table["_head"].to_pandas(), table["_sep"].to_pandas()
    key = head.fillna("\0").astype(str) + "\1" + sep.fillna("\0").astype(str)
    codes, _ = key.factorize()
    text = pc.replace_substring_regex(table["line"].combine_chunks(), "\r$", "")
    ids, numbers = table["file_id"].combine_chunks(), table["line_no"].combine_chunks()
    parts = []
    for code in range(codes.max() + 1 if len(codes) else 0):
        at = np.flatnonzero(codes == code)
        h, s = head.iloc[at[0]], sep.iloc[at[0]]
        good: list = []
        bad: list = []
        if not isinstance(h, str) or not isinstance(s, str) or len(s) != 1:
            bad = [(k, "no_header") for k in at]
        else:
            names = read_header(h, s)
            unique = [n if n not in names[i + 1:] else f"{n}\0{i}" for i, n in enumerate(names)]
            e = re.escape(s)
            field = rf'(?:[^"{e}]*|"(?:[^"]|"")*")'
            _load(text.take(pa.array(at)), at, s, unique, rf"^{field}(?:{e}{field})*$", good, bad)
        for where, loaded in good:
            rows = pa.array(where)
            columns = {"file_id": ids.take(rows), "line_no": numbers.take(rows), "reason": pa.nulls(len(where), pa.string())}
            for name, target in _FIELDS.items():
                kind = _SCHEMA.field(target).type
                columns[target] = loaded[name].combine_chunks().cast(kind) if name in loaded.column_names else pa.nulls(len(where), kind)
            parts.append(pa.table([columns[f.name] for f in _SCHEMA], schema=_SCHEMA))
        if bad:
            rows = pa.array([k for k, _ in bad])
            columns = {"file_id": ids.take(rows), "line_no": numbers.take(rows), "reason": pa.array([r for _, r in bad])}
            parts.append(pa.table([columns.get(f.name, pa.nulls(len(bad), f.type)) for f in _SCHEMA], schema=_SCHEMA))
    return pa.concat_tables(parts) if parts else _SCHEMA.empty_table()


def failed_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Only the failing lines, with their reason."""
    return load_lines(lines, files).where("reason is not null").select("file_id", "line_no", "reason")
