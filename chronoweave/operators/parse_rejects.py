"""Rows that fail to parse: text lines to typed edges, with every invalid line kept apart together with its reason.

A batch of lines becomes one in-memory CSV file whose first field is the line's number in the batch. pyarrow's CSV reader
calls back for each line with a wrong number of fields (the structural rejects); all fields of the others arrive as
strings and are then checked and cast as whole vectors, each failing cell with a label of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INT_MAX = 2147483647
#: The fields of each dump format, in order.
FIELDS = {"csv": ["eid", "src", "dst", "time", "ext_roll"], "ws": ["src", "dst", "time"]}
MOST = {"ext_roll": 2}
_VALUES = ["eid", "src", "dst", "time", "ext_roll"]
_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
_QUOTING = rf"(?s)\A{_FIELD}(?:,{_FIELD})*\z"
_ENDS = " \t\r"
#: Stands for a CR inside a line, so that the reader doesn't end the line there; an original one becomes \x1f.
_CR = "\x1e"
RESULT = "line_id long, file_name string, line_no long, fmt string, line string, reason string, eid long, src long, dst long, time long, ext_roll int"


def _plain(lines: pa.Array) -> pa.Array:
    out = pc.replace_substring(lines, _CR, "\x1f")
    out = pc.replace_substring(out, "\r", _CR)
    return pc.replace_substring(out, "\n", "\x1f")


def _structure(at: pa.Array, lines: pa.Array, fmt: str) -> tuple[dict[str, pa.Array], dict[int, str]]:
    """Fields as strings of the lines that have the right number of them, and the reason for each other line."""
    names, bad = FIELDS[fmt], {}
    sep = "," if fmt == "csv" else "\t"
    if fmt == "ws":
        lines = pc.replace_substring_regex(lines, r"[ \t]+", "\t")
    numbered = pc.binary_join_element_wise(at.cast(pa.string()), lines, sep)
    data = "\n".join(numbered.to_pylist()).encode() + b"\n"

    def reject(row: csv.InvalidRow) -> str:
        k, _, rest = row.text.partition(sep)
        bad[int(k)] = "empty_line" if not rest.strip(_ENDS + _CR) else f"column_count:{row.actual_columns - 1}"
        return "skip"

    parsed = csv.read_csv(
        pa.py_buffer(data),
        read_options=csv.ReadOptions(column_names=["_at", *names], use_threads=False, block_size=max(len(data) + 1, 1 << 16)),
        parse_options=csv.ParseOptions(delimiter=sep, quote_char='"' if fmt == "csv" else False, double_quote=fmt == "csv", invalid_row_handler=reject),
        convert_options=csv.ConvertOptions(column_types={"_at": pa.int64()} | {n: pa.string() for n in names}, strings_can_be_null=False),
    )
    return {n: parsed[n].combine_chunks() for n in parsed.column_names}, bad


def _cells(fields: dict[str, pa.Array], names: list[str]) -> tuple[dict[str, pa.Array], pa.Array]:
    """Cast each field; one text per row with the labels of its failing cells, null where all are valid."""
    values, labels = {}, []
    for n in names:
        text = pc.utf8_trim(fields[n], " \t" + _CR)
        digits = pc.match_substring_regex(text, r"\A[0-9]+\z")
        short = pc.utf8_ltrim(pc.if_else(digits, text, "0"), "0")
        fits = pc.less_equal(pc.utf8_length(short), 10)
        number = pc.if_else(pc.and_(fits, pc.greater(pc.utf8_length(short), 0)), short, "0").cast(pa.int64())
        fits = pc.and_(fits, pc.less_equal(number, MOST.get(n, INT_MAX)))
        kind = pc.if_else(pc.equal(text, ""), f"{n}:empty; ", pc.if_else(digits, f"{n}:out_of_range; ", f"{n}:not_digits; "))
        labels.append(pc.if_else(pc.and_(digits, fits), "", kind))
        values[n] = number
    reason = pc.utf8_rtrim(pc.binary_join_element_wise(*labels, ""), "; ")
    reason = pc.if_else(pc.equal(reason, ""), pa.scalar(None, pa.string()), reason)
    return {n: pc.if_else(pc.is_null(reason), v, pa.scalar(None, pa.int64())) for n, v in values.items()}, reason


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out_schema = pa.schema([("line_id", pa.int64()), ("file_name", pa.string()), ("line_no", pa.int64()), ("fmt", pa.string()), ("line", pa.string()), ("reason", pa.string()), *((n, pa.int64()) for n in _VALUES[:4]), ("ext_roll", pa.int32())])
    part_schema = pa.schema([("_at", pa.int64()), ("reason", pa.string()), *((n, pa.int64()) for n in _VALUES)])
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        at, line, fmt = pa.array(range(n), pa.int64()), batch.column("line"), batch.column("fmt")
        parts: list[pa.Table] = []

        def keep(where: pa.Array, reason: str) -> None:
            rows = at.filter(where)
            parts.append(pa.table({"_at": rows, "reason": pa.array([reason] * len(rows), pa.string())} | {k: pa.nulls(len(rows), pa.int64()) for k in _VALUES}, part_schema))

        known = pc.fill_null(pc.is_in(fmt, pa.array(list(FIELDS))), False)
        there = pc.is_valid(line)
        keep(pc.invert(there), "null_line")
        keep(pc.and_(there, pc.invert(known)), "unknown_format")
        text = pc.utf8_trim(pc.fill_null(line, ""), _ENDS)
        for f, names in FIELDS.items():
            mine = pc.and_(there, pc.fill_null(pc.equal(fmt, f), False))
            if f == "csv":
                whole = pc.match_substring_regex(text, _QUOTING)
                keep(pc.and_(mine, pc.invert(whole)), "broken_quoting")
                mine = pc.and_(mine, whole)
            rows = at.filter(mine)
            if not len(rows):
                continue
            fields, bad = _structure(rows, _plain(text.filter(mine)), f)
            parts.append(pa.table({"_at": list(bad), "reason": list(bad.values())} | {k: pa.nulls(len(bad), pa.int64()) for k in _VALUES}, part_schema))
            values, reason = _cells(fields, names)
            parts.append(pa.table({"_at": fields["_at"], "reason": reason} | {k: values.get(k, pa.nulls(len(reason), pa.int64())) for k in _VALUES}, part_schema))
        done = pa.concat_tables(parts).sort_by("_at")
        cols = [batch.column("line_id"), batch.column("file_name"), batch.column("line_no"), fmt, line, *(done[k].combine_chunks() for k in ["reason", *_VALUES])]
        yield from pa.Table.from_arrays(cols, names=out_schema.names).cast(out_schema).to_batches()


def parse_lines(lines: DataFrame, drop_header: bool = True) -> DataFrame:
    """Each line as a typed edge (reason null) or with the reason why it isn't one (all values null); one pass, no shuffle.

    lines needs line_id, file_name, fmt, line_no, line; further columns are ignored, so names can't clash. Line 1 of a file is a
    header and left out when drop_header; a null line_no counts as no header. Null lines give `null_line`, formats other
    than csv and ws (and null) `unknown_format`, blank lines `empty_line`, a wrong number of fields `column_count:N`,
    misplaced or open quotes `broken_quoting`, and values `COLUMN:empty`, `COLUMN:not_digits` or `COLUMN:out_of_range`,
    joined by "; ". `ws` lines have no eid and ext_roll: these are null. Repeated lines are kept, each under its own line_id.
    An empty table gives an empty table. A line may be as long as Arrow holds.
    """
    rows = lines.select(F.col("line_id").cast("long"), F.col("file_name").cast("string"), F.col("fmt").cast("string"), F.col("line_no").cast("long"), F.col("line").cast("string"))
    if drop_header:
        rows = rows.filter(~F.col("line_no").eqNullSafe(1))
    return rows.mapInArrow(_parse, RESULT)


def typed_edges(parsed: DataFrame) -> DataFrame:
    """The valid lines of parse_lines, as edges."""
    return parsed.filter("reason is null").select("line_id", "eid", "src", "dst", "time", "ext_roll")


def rejects(parsed: DataFrame) -> DataFrame:
    """The invalid lines of parse_lines, as they were, with their reasons."""
    return parsed.filter("reason is not null").select("line_id", "file_name", "line_no", "fmt", "line", "reason")
