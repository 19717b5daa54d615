"""Rows that fail to parse: typed rows, and the rest with the reason.

A csv file is read as physical lines, and its records are put together quote-aware: a line that ends inside a quoted cell goes on in the next. Each
partition carries its state of quotes through a summary of one row, so no line is read by one task alone (``csv_rows``). Rows of ``raw_rows`` come so
put together: each raw is one record, and a quoted cell that it leaves open is ``broken``. A record is read by Python's strict csv reader or as
JSON, structural failures are caught before any typed value is made, and only then the values are constructed, within a partition: loading
needs no shuffle. The specifications of the inputs are joined by ``input_path``.

Reasons, the first that holds: ``broken``, ``wrong_shape``, ``bad_value``. Defined cases: a null raw line is ``broken``; a row whose
input has no specification is ``wrong_shape``; extra columns of the input table are ignored.
"""

from __future__ import annotations

import csv
import datetime
import io
import json
import re
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import spread, written

csv.field_size_limit(sys.maxsize)
INT = re.compile(r"[+-]?[0-9]+\Z")
FLOAT = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\Z")
DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}\Z")
ID = "id"


class Quotes:
    """Whether the text so far ends inside a quoted cell; lines are fed one after the other, each character once."""

    def __init__(self, delimiter: str = ","):
        self.mark = re.compile(f'"|{re.escape(delimiter)}')
        self.quoted = False

    def feed(self, line: str) -> bool:
        """The state after one more line. A quote opens a cell at its very beginning only; inside, two in a row are one."""
        at, start = 0, True
        while True:
            if self.quoted:
                end = line.find('"', at)
                if end < 0:
                    return True
                if line.startswith('""', end):
                    at = end + 2
                    continue
                self.quoted, at, start = False, end + 1, False
            if start and line.startswith('"', at):
                self.quoted, at, start = True, at + 1, False
                continue
            found = self.mark.search(line, at)
            while found and found[0] == '"':
                found = self.mark.search(line, found.end())
            if not found:
                return False
            at, start = found.end(), True


def assemble(lines: Iterable[str], delimiter: str = ",", quoted: bool = False) -> Iterator[str]:
    """Put the lines of a csv file together into records; ``quoted``: the first line goes on inside a cell."""
    held: list[str] = []
    state = Quotes(delimiter)
    state.quoted = quoted
    for line in lines:
        held.append(line)
        if not state.feed(line):
            yield "\n".join(held)
            held.clear()
    if held:
        yield "\n".join(held)


def _states(delimiter: str):
    """(part, plain, quoted): the state at the end of each partition, for either state at its beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[int, list[Quotes]] = {}
        for batch in batches:
            for part, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part not in ends:
                    ends[part] = [Quotes(delimiter), Quotes(delimiter)]
                    ends[part][1].quoted = True
                for state in ends[part]:
                    state.feed(line)
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(ends), pa.int32()), "plain": [e[0].quoted for e in ends.values()], "quoted": [e[1].quoted for e in ends.values()]}, schema=pa.schema([("part", pa.int32()), ("plain", pa.bool_()), ("quoted", pa.bool_())]))

    return run


def _assembled(delimiter: str):
    """(part, at, raw, open): the records that begin or end in each partition; ``open``: 1 goes on into the next, 2 began in an earlier one, 3 both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held, part, at, first, into = Quotes(delimiter), [], None, 0, False, False
        for batch in batches:
            rows = []
            for p, line, quoted in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if part is None:
                    part, state.quoted, into = p, quoted, quoted
                held.append(line)
                if not state.feed(line):
                    rows.append((part, at, "\n".join(held), 2 if into else 0))
                    at, into = at + 1, False
                    held.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.string(), pa.int32()))], names=["part", "at", "raw", "open"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array(["\n".join(held)]), pa.array([3 if into else 1], pa.int32())], names=["part", "at", "raw", "open"])

    return run


def csv_rows(spark: SparkSession, path: str, input_path: str | None = None, delimiter: str = ",") -> DataFrame:
    """The records of a csv file as rows to parse: (row_id, input_path, raw), a raw holding the line breaks of its quoted cells.

    Ids rise in file order. The pieces of the few records that cross partitions are put together by the partition in which they begin; every other record
    stays in its task. Carriage returns at the end of a line are dropped outside quotes and kept inside, as part of the cell.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.spark_partition_id().alias("part"), "value")
    ends = sorted(written(lines.mapInArrow(_states(delimiter), "part int, plain boolean, quoted boolean")).collect())  # a row for each partition
    starts, quoted = [], False
    for end in ends:
        starts.append((end.part, quoted))
        quoted = end.quoted if quoted else end.plain
    begins = spark.createDataFrame(starts, "part int, inside boolean")
    pieces = written(lines.join(F.broadcast(begins), "part").select("part", "value", "inside").mapInArrow(_assembled(delimiter), "part int, at long, raw string, open int"))
    whole = pieces.where("open = 0").select("part", "at", "raw")
    crossing = pieces.where("open > 0")
    chain = crossing.withColumn("chain", F.sum((F.col("open") == 1).cast("int")).over(Window.orderBy("part", "at")))  # at most two rows for each partition
    joined = chain.groupBy("chain").agg(F.min(F.struct("part", "at")).alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "at", "raw"))), lambda x: x["raw"]), "\n").alias("raw"))
    rows = whole.unionByName(joined.select("first.part", "first.at", "raw"))
    return rows.select((F.shiftleft(F.col("part").cast("long"), 33) + F.col("at") + 1).alias("row_id"), F.lit(input_path or path).alias("input_path"), F.regexp_replace("raw", r"\r$", "").alias("raw"))


def spec_of(column_spec: str) -> list[tuple[str, str]]:
    """``name:type,...`` as pairs, in file order."""
    return [tuple(part.rsplit(":", 1)) for part in column_spec.split(",")]  # type: ignore[misc]


def _no_constant(name: str) -> float:
    raise ValueError(f"{name} is not JSON")


def _whole(value: int) -> int:
    if not -(1 << 63) <= value < 1 << 63:
        raise ValueError("not a whole number of 64 bits")
    return value


def _day(text: str) -> str:
    if not DATE.match(text):
        raise ValueError("not a day")
    datetime.date.fromisoformat(text)
    return text


def _from_cell(cell: str, kind: str) -> object:
    if kind == "string":
        return cell
    if kind == "int":
        if not INT.match(cell):
            raise ValueError("not a whole number")
        return _whole(int(cell)) if len(cell) < 40 else _whole(1 << 63)
    if kind == "float":
        if not FLOAT.match(cell):
            raise ValueError("not a number")
        return float(cell)
    return _day(cell)


def _from_json(value: object, kind: str) -> object:
    if kind in ("string", "date"):
        if not isinstance(value, str):
            raise ValueError("not a string")
        return value if kind == "string" else _day(value)
    if isinstance(value, bool) or not isinstance(value, int if kind == "int" else (int, float)):
        raise ValueError("not a number")
    return _whole(value) if kind == "int" else float(value)


def parse_row(raw: str | None, kind: str, delimiter: str | None, columns: list[tuple[str, str]] | None, text_field: str | None) -> tuple[str | None, dict | None]:
    """(reason, None) or (None, values by column)."""
    if raw is None:
        return "broken", None
    if columns is None:
        return "wrong_shape", None
    if kind == "jsonl":
        try:
            found = json.loads(raw, parse_constant=_no_constant)
        except (ValueError, RecursionError):
            return "broken", None
        if not isinstance(found, dict) or any(name not in found for name, _ in columns):
            return "wrong_shape", None
        cells, make = [found[name] for name, _ in columns], _from_json
    else:
        try:
            records = list(csv.reader(io.StringIO(raw.replace("\0", "�"), newline=""), delimiter=delimiter or ",", strict=True))
        except csv.Error:
            return "broken", None
        if len(records) != 1 or len(records[0]) != len(columns):
            return "wrong_shape", None
        cells, make = [cell if cell != "" else None for cell in records[0]], _from_cell
    values: dict[str, object] = {}
    for (name, of), cell in zip(columns, cells):
        needed = name == ID or name == text_field
        if cell is None or cell == "":
            if needed and (cell is None or of != "string" or kind == "csv"):
                return "bad_value", None
            if cell is None:
                values[name] = None
                continue
        try:
            values[name] = make(cell, of)
        except (ValueError, OverflowError):
            return "bad_value", None
    return None, values


#: Arrow types of the types of a specification.
TYPES = {"int": pa.int64(), "float": pa.float64(), "string": pa.string(), "date": pa.date32()}
SPECIFIED = ("input_format", "delimiter", "column_spec", "text_field")


def _parse(columns: list[tuple[str, str]] | None):
    """(row_id, reason), and with ``columns`` their typed values of the sound rows alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specs: dict[str, list[tuple[str, str]]] = {}
        for batch in batches:
            got = batch.to_pydict()
            ids, reasons, rows = [], [], []
            for at, raw, kind, delimiter, spec, text_field in zip(got["row_id"], got["raw"], *(got[name] for name in SPECIFIED)):
                if spec is not None and spec not in specs:
                    specs[spec] = spec_of(spec)
                reason, values = parse_row(raw, kind, delimiter, specs.get(spec), text_field)
                if (reason is None) == (columns is not None):
                    ids.append(at)
                    reasons.append(reason)
                    rows.append(values)
            out = [pa.array(ids, pa.int64()), pa.array(reasons, pa.string())]
            for name, of in columns or ():
                made = [row[name] for row in rows]
                out.append(pa.array([None if x is None else datetime.date.fromisoformat(x) for x in made] if of == "date" else [x.encode("utf-8", "replace").decode() if isinstance(x, str) else x for x in made], TYPES[of]))
            yield pa.RecordBatch.from_arrays(out, names=["row_id", "reason" if columns is None else "_reason", *(name for name, _ in columns or ())])

    return run


def specified(raw_rows: DataFrame, inputs: DataFrame, id_col: str) -> DataFrame:
    """(row_id, raw) with the specification of each row's input."""
    specs = inputs.groupBy("input_path").agg(*(F.first(c).alias(c) for c in SPECIFIED))
    rows = spread(raw_rows.select(F.col(id_col).cast("long").alias("row_id"), "input_path", "raw")).join(specs, "input_path", "left")
    return rows.select("row_id", "raw", *SPECIFIED)


def failures(raw_rows: DataFrame, inputs: DataFrame, id_col: str = "row_id") -> DataFrame:
    """(row_id, reason) of the rows that can't be loaded."""
    return specified(raw_rows, inputs, id_col).mapInArrow(_parse(None), "row_id long, reason string")


def loaded(raw_rows: DataFrame, inputs: DataFrame, column_spec: str, id_col: str = "row_id") -> DataFrame:
    """The sound rows of the inputs with this ``column_spec`` as typed columns; lone surrogates of JSON become question marks."""
    sql = {"int": "bigint", "float": "double", "string": "string", "date": "date"}
    columns = spec_of(column_spec)
    schema = ", ".join(["row_id long, _reason string", *(f"`{name}` {sql[kind]}" for name, kind in columns)])
    found = specified(raw_rows, inputs.where(F.col("column_spec") == column_spec), id_col)
    return found.where(F.col("column_spec").isNotNull()).mapInArrow(_parse(columns), schema).drop("_reason")
