"""Spreadsheet workbooks as DataFrames.

``spark.read.format("xlsx")`` (after :func:`register`) has one partition for each file, small ones sharing one; files are opened by the tasks alone.  Options:

* ``path``: file, folder or glob; ``sheet``: number from 1 or name in either case (default: all sheets in
  ``cells`` mode, the first in ``wide`` mode); ``header`` (true): the first row names the columns;
* ``mode``: ``cells`` (default: long rows of typed cells), ``sheets`` (the sheets) or ``wide`` (one column for each header, taken
  as in the given schema: text, number, time or boolean, null where a cell can't be converted);
* ``splitSheets`` (false): in ``cells`` mode a partition for each sheet, for which the driver opens the files;
* ``autoDetectDates`` (true), ``maxPartBytes``, ``password``, ``failFast`` (false: a broken cell reference is skipped).

:func:`read_binary` does the same for ``binaryFile`` rows, for file systems that only Spark can reach.
"""

from __future__ import annotations

import datetime as dt
import glob
import io
import os
import re
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType, TimestampNTZType, TimestampType

from ..functions.dates import is_date_format
from . import sheet_scan
from .package import MAX_PART_BYTES, Package, local, resolve
from .sheet_scan import DATE, KINDS, NUMBER, STRING, Columns

CELLS = "path string, sheet string, sheet_index int, row int, col int, kind string, text string, number double, flag boolean, time timestamp_ntz, formula string"
SHEETS = "path string, sheet_index int, name string, part string"

#: Bytes of small workbooks that one task reads, one after another.
PACK_BYTES = 1 << 20

EPOCH = dt.datetime(1899, 12, 30)
_LETTERS = re.compile(r"([A-Za-z]+)([0-9]*)$")


def from_serial(days: float, date1904: bool = False) -> dt.datetime | None:
    """A serial number's time, to the millisecond; None out of range."""
    try:
        return EPOCH + dt.timedelta(milliseconds=round((days + (1462 if date1904 else 0)) * 86_400_000))
    except OverflowError:
        return None


def to_serial(t: dt.datetime | dt.date | dt.timedelta) -> float:
    if isinstance(t, dt.timedelta):
        return t / dt.timedelta(days=1)
    if not isinstance(t, dt.datetime):
        t = dt.datetime(t.year, t.month, t.day)
    return (t.replace(tzinfo=None) - EPOCH) / dt.timedelta(days=1)


def column_index(reference: str) -> tuple[int, int | None]:
    """(column, row) of a reference such as B12, the row None if it has none."""
    m = _LETTERS.match(reference.replace("$", ""))
    if not m:
        raise ValueError(f"not a cell reference: {reference!r}")
    n = 0
    for c in m[1].upper():
        n = n * 26 + ord(c) - 64
    if n > 16_384:
        raise ValueError(f"not a cell reference: {reference!r}")
    return n, int(m[2]) if m[2] else None


class Workbook:
    """A workbook's package, shared strings, styles and sheets."""

    def __init__(self, data: bytes, *, password: str | None = None, max_part_bytes: int | None = MAX_PART_BYTES, auto_dates: bool = True):
        if data[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
            from .encryption import decrypt

            data = decrypt(data, password)
        self.package = Package(data, max_part_bytes)
        self.auto_dates = auto_dates
        main = self.package.main()
        root = ElementTree.fromstring(self.package.read(main))
        rels = {r.id: r for r in self.package.rels(main)}
        self.date1904 = any(local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in root)
        self.sheets: list[tuple[str, str]] = []
        self.defined_names: dict[str, str] = {}
        for group in root:
            if local(group.tag) == "sheets":
                for s in group:
                    id = next((v for k, v in s.attrib.items() if local(k) == "id"), "")
                    r = rels.get(id)
                    if r and r.kind.endswith("/worksheet"):
                        self.sheets.append((s.get("name", ""), resolve(main, r.target)))
            elif local(group.tag) == "definedNames":
                self.defined_names |= {e.get("name", ""): e.text or "" for e in group}
        strings = self.package.related(main, "sharedStrings") or [n for n in self.package.names if n.endswith("sharedStrings.xml")]
        styles = self.package.related(main, "styles") or [n for n in self.package.names if n.endswith("styles.xml")]
        self.strings = self._strings(strings[0]) if strings and strings[0] in self.package.names else []
        self.dates = self._styles(styles[0]) if styles and styles[0] in self.package.names else []

    def _strings(self, name: str) -> list[str]:
        out = []
        for si in ElementTree.fromstring(self.package.read(name)):
            out.append(_rich(si))
        return out

    def _styles(self, name: str) -> list[bool]:
        """Whether each cell format is a date's."""
        codes: dict[int, str] = {}
        out: list[bool] = []
        for group in ElementTree.fromstring(self.package.read(name)):
            if local(group.tag) == "numFmts":
                codes |= {int(e.get("numFmtId", 0)): e.get("formatCode", "") for e in group}
            elif local(group.tag) == "cellXfs":
                for e in group:
                    i = int(e.get("numFmtId", 0))
                    out.append(is_date_format(i, codes.get(i)))
        return out

    def sheet(self, which: int | str) -> int:
        """Index from 0 of a sheet by number from 1 or by name."""
        if isinstance(which, int) or which.isdigit() and all(n.lower() != which for n, _ in self.sheets):
            if not 1 <= int(which) <= len(self.sheets):
                raise ValueError(f"there is no sheet {which} of {len(self.sheets)}")
            return int(which) - 1
        for i, (n, _) in enumerate(self.sheets):
            if n.lower() == which.lower():
                return i
        raise ValueError(f"no sheet {which!r} among {[n for n, _ in self.sheets]}")

    def cells(self, index: int, fail_fast: bool = False) -> Iterator[tuple[int, int, str, object, str | None]]:
        """(row, column, kind, value, formula) of each cell that holds either, in the sheet's order."""
        row, columns = 0, {}
        for _, e in ElementTree.iterparse(io.BytesIO(self.package.read(self.sheets[index][1])), ("end",)):
            if not e.tag.endswith("row") or local(e.tag) != "row":
                continue
            row = int(e.get("r") or row + 1)
            col = 0
            for c in e:
                if not c.tag.endswith("c") or local(c.tag) != "c":
                    continue
                ref = c.get("r")
                if ref:
                    letters = ref.rstrip("0123456789")
                    if letters not in columns:
                        try:
                            columns[letters] = column_index(ref)[0]
                        except ValueError:
                            if fail_fast:
                                raise
                            continue
                    col = columns[letters]
                else:
                    col += 1
                kind, value, formula = self._cell(c)
                if value is not None or formula is not None:
                    yield row, col, kind, value, formula
            e.clear()

    def columns(self, index: int, fail_fast: bool = False) -> Iterator[Columns]:
        """The same cells in columns, some ten thousands at a time, rows being whole."""
        dates = np.array(self.dates if self.auto_dates else [], bool)
        return sheet_scan.scan(self.package.read(self.sheets[index][1]), pa.array(self.strings, pa.string()), dates, 1462 if self.date1904 else 0, self.cells(index, fail_fast))

    def _cell(self, c) -> tuple[str, object, str | None]:
        raw = formula = inline = None
        for x in c:
            tag = local(x.tag)
            if tag == "v":
                raw = x.text or ""
            elif tag == "f":
                formula = x.text
            elif tag == "is":
                inline = _rich(x)
        t = c.get("t", "n")
        if inline is not None:
            return "string", inline, formula
        if raw is None:
            return "blank", None, formula
        if t == "s":
            return "string", self.strings[int(raw)] if raw.isdigit() and int(raw) < len(self.strings) else raw, formula
        if t == "b":
            return "bool", raw == "1", formula
        if t == "e":
            return "error", raw, formula
        if t == "str":
            return "string", raw, formula
        if t == "d":
            try:
                return "date", dt.datetime.fromisoformat(raw).replace(tzinfo=None), formula
            except ValueError:
                return "string", raw, formula
        try:
            number = float(raw)
        except ValueError:
            return "string", raw, formula
        style = int(c.get("s", 0))
        if self.auto_dates and style < len(self.dates) and self.dates[style]:
            time = from_serial(number, self.date1904)
            if time is not None:
                return "date", time, formula
        return "number", number, formula


def _rich(e) -> str:
    """The text of a string item: its runs joined, without phonetic ones."""
    out = []
    for x in e:
        if local(x.tag) == "t":
            out.append(x.text or "")
        elif local(x.tag) == "r":
            out += [t.text or "" for t in x if local(t.tag) == "t"]
    return "".join(out)


def convert(kind: str, value, to: DataType, date1904: bool = False):
    """A cell's value as a column's type, None where it can't be."""
    if value is None:
        return None
    try:
        if isinstance(to, StringType):
            return ("TRUE" if value else "FALSE") if kind == "bool" else value.isoformat(sep=" ") if kind == "date" else repr(value).removesuffix(".0") if kind == "number" else value
        if isinstance(to, (TimestampNTZType, TimestampType, DateType)):
            t = value if kind == "date" else from_serial(float(value), date1904) if kind == "number" else dt.datetime.fromisoformat(value) if kind == "string" else None
            return t.date() if t is not None and isinstance(to, DateType) else t
        if kind == "date":
            value = to_serial(value)
        if isinstance(to, BooleanType):
            return value if kind == "bool" else float(value) != 0 if kind in ("number", "date") else {"true": True, "false": False, "1": True, "0": False}.get(value.strip().lower())
        if isinstance(to, (IntegerType, LongType, ShortType)):
            n = round(float(value)) if not isinstance(value, str) or "." in value or "e" in value.lower() else int(value)
            bits = {ShortType: 15, IntegerType: 31, LongType: 63}[type(to)]
            return n if -(2**bits) <= n < 2**bits else None
        if isinstance(to, (DoubleType, FloatType)):
            return float(value)
        if isinstance(to, DecimalType):
            return round(Decimal(str(value)), to.scale)
    except (ValueError, OverflowError, InvalidOperation):
        return None
    raise TypeError(f"a sheet has no columns of type {to.simpleString()}")


class _Part(InputPartition):
    def __init__(self, paths: list[str], sheet: int | None = None):
        self.paths, self.sheet = paths, sheet


def _packed(paths: list[str]) -> list[list[str]]:
    """Neighbouring files together up to PACK_BYTES, larger ones alone."""
    out: list[list[str]] = []
    room = 0
    for p in paths:
        n = os.path.getsize(p)
        if out and n <= room:
            out[-1].append(p)
        else:
            out.append([p])
            room = PACK_BYTES
        room -= n
    return out


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.lower().endswith(".xlsx") and not f.startswith((".", "~")))
    return sorted(glob.glob(path)) or [path]


def _flag(options: dict, key: str, default: bool) -> bool:
    return str(options.get(key.lower(), options.get(key, default))).lower() == "true"


def _open(data: bytes, options: dict) -> Workbook:
    cap = options.get("maxpartbytes", options.get("maxPartBytes"))
    return Workbook(data, password=options.get("password"), max_part_bytes=int(cap) if cap else MAX_PART_BYTES, auto_dates=_flag(options, "autoDetectDates", True))


_CELL_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.timestamp("us"), pa.string()]


def cell_batches(path: str, book: Workbook, index: int, fail_fast: bool) -> Iterator[pa.RecordBatch]:
    name = book.sheets[index][0]
    names = [c.split()[0] for c in CELLS.split(", ")]
    for c in book.columns(index, fail_fast):
        n = len(c)
        only = lambda x, kind: pa.array(x, mask=c.kind != kind)  # noqa: B023, E731
        cols = [pa.repeat(path, n), pa.repeat(name, n), pa.repeat(index + 1, n), pa.array(c.row), pa.array(c.col), pa.array(KINDS).take(pa.array(c.kind)), c.text, only(c.number, NUMBER), only(c.flag, KINDS.index("bool")), only(c.time.view("M8[us]"), DATE), c.formula]
        yield pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip(cols, _CELL_TYPES)], names)


def _decimals(x: np.ndarray, to: DecimalType) -> pa.Array:
    """Numbers as decimals, rounded as their shortest text is, null where there is no room."""
    scaled = x * 10.0**to.scale
    whole = np.rint(scaled)
    odd = ~(np.abs(scaled) < 2**53) | (np.abs(scaled - whole) > 1e-6 * np.maximum(1, np.abs(scaled) * 1e-9))
    low = np.where(odd, 0, whole).astype(np.int64)
    fits = np.abs(low) < 10 ** min(to.precision, 18)
    pair = np.stack([low, low >> 63], 1)
    valid = pa.array(fits).buffers()[1]
    out = pa.Array.from_buffers(pa.decimal128(to.precision, to.scale), len(x), [valid, pa.py_buffer(np.ascontiguousarray(pair))])
    i = np.flatnonzero(odd)
    if not len(i):
        return out
    values = out.to_pylist()
    for k in i.tolist():
        v = convert("number", float(x[k]), to)
        values[k] = v if v is not None and abs(v) < Decimal(10) ** (to.precision - to.scale) else None
    return pa.array(values, out.type)


def _column(c: Columns, at: np.ndarray, to: DataType, date1904: bool) -> pa.Array:
    """The cells at the places, none being -1, as a column of a type."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(to)
    has = at >= 0
    p = at[has]
    one = int(c.kind[p[0]]) if len(p) and (c.kind[p] == c.kind[p[0]]).all() else None
    if one == STRING and isinstance(to, StringType):
        values = c.text.take(pa.array(p))
    elif one == NUMBER and isinstance(to, (DoubleType, FloatType)):
        values = pa.array(c.number[p]).cast(kind, safe=False)
    elif one == NUMBER and isinstance(to, (IntegerType, LongType, ShortType)):
        x = np.rint(c.number[p])
        bits = {ShortType: 15, IntegerType: 31, LongType: 63}[type(to)]
        fits = (x >= -(2.0**bits)) & (x < 2.0**bits)
        values = pa.array(np.where(fits, x, 0).astype(np.int64), mask=~fits).cast(kind)
    elif one == NUMBER and isinstance(to, DecimalType):
        values = _decimals(c.number[p], to)
    elif one == DATE and isinstance(to, (TimestampNTZType, DateType)):
        values = pa.array(c.time[p].view("M8[us]")).cast(kind, safe=False)
    else:
        values = [convert(KINDS[c.kind[i]], c.value(i), to, date1904) for i in p.tolist()]
        if isinstance(to, TimestampType):
            values = [None if v is None else v.astimezone(dt.UTC) for v in values]
        values = pa.array(values, kind)
    return values.take(pa.array(np.cumsum(has) - 1, mask=~has))


def wide_batches(book: Workbook, index: int, schema: StructType, header: bool, fail_fast: bool) -> Iterator[pa.RecordBatch]:
    """Rows by header (in either case, the first of equal ones) or by place, converted to the schema."""
    places: dict[str, int] = {}
    started = not header
    for c in book.columns(index, fail_fast):
        if not started:
            n = int(np.searchsorted(c.row != c.row[0], True))
            for i in range(n):
                if c.kind[i] == STRING and (name := c.value(i)):
                    places.setdefault(name.lower(), int(c.col[i]))
            started = True
            c = c.since(n)
        if not len(c):
            continue
        row = np.cumsum(np.append(True, c.row[1:] != c.row[:-1])) - 1
        cols = []
        for i, f in enumerate(schema.fields):
            at = np.full(row[-1] + 1, -1)
            mine = np.flatnonzero(c.col == (places.get(f.name.lower(), 0) if header else i + 1))
            at[row[mine]] = mine
            cols.append(_column(c, at, f.dataType, book.date1904))
        yield pa.RecordBatch.from_arrays(cols, schema.fieldNames()) if cols else pa.RecordBatch.from_pylist([{}] * int(row[-1] + 1))


class XlsxReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, {k.lower(): v for k, v in options.items()}
        self.mode = self.options.get("mode", "cells")

    def partitions(self):
        paths = _files(self.options["path"])
        if self.mode != "cells" or self.options.get("sheet") or not _flag(self.options, "splitSheets", False):
            return [_Part(p) for p in _packed(paths)]
        out = []
        for path in paths:
            with open(path, "rb") as f:
                out += [_Part([path], i) for i in range(len(_open(f.read(), self.options).sheets))]
        return out

    def read(self, partition: _Part):
        for path in partition.paths:
            yield from self._read(path, partition.sheet)

    def _read(self, path: str, sheet: int | None):
        with open(path, "rb") as f:
            book = _open(f.read(), self.options)
        fail = _flag(self.options, "failFast", False)
        which = self.options.get("sheet") or ("1" if self.mode == "wide" else None)
        if self.mode == "sheets":
            yield from ((path, i + 1, n, p) for i, (n, p) in enumerate(book.sheets))
        elif self.mode == "cells":
            for i in [book.sheet(which)] if which else [sheet] if sheet is not None else range(len(book.sheets)):
                yield from cell_batches(path, book, i, fail)
        else:
            yield from wide_batches(book, book.sheet(which), self.schema, _flag(self.options, "header", True), fail)


class XlsxDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self):
        mode = {k.lower(): v for k, v in self.options.items()}.get("mode", "cells")
        if mode == "wide":
            return wide_schema({k.lower(): v for k, v in self.options.items()})
        return SHEETS if mode == "sheets" else CELLS

    def reader(self, schema: StructType) -> XlsxReader:
        return XlsxReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool):
        from .xlsx_writer import XlsxDataWriter

        return XlsxDataWriter(schema, dict(self.options), overwrite)


def wide_schema(options: dict) -> StructType:
    """Text columns named by the first file's header row; ColumnN where a header is missing, also beyond the last one."""
    with open(_files(options["path"])[0], "rb") as f:
        book = _open(f.read(), options)
    names: dict[int, str] = {}
    first, last = None, 0
    for row, col, kind, value, _ in book.cells(book.sheet(options.get("sheet") or "1")):
        first = row if first is None else first
        last = max(last, col)
        if row == first and kind == "string" and value and _flag(options, "header", True):
            names[col] = value
    seen: set[str] = set()
    out = StructType()
    for col in range(1, last + 1):
        n = names.get(col, f"Column{col}")
        n = n if n.lower() not in seen else f"Column{col}"
        seen.add(n.lower())
        out.add(n, StringType())
    return out


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxDataSource)


def read_sheets(spark: SparkSession, path: str, **options) -> dict[str, DataFrame]:
    """Every sheet of a workbook as a wide DataFrame of text, by name."""
    register(spark)
    rows = spark.read.format("xlsx").options(mode="sheets", path=path, **options).load().orderBy("sheet_index").collect()
    return {r.name: spark.read.format("xlsx").options(mode="wide", path=path, sheet=str(r.sheet_index), **options).load() for r in rows}


def read_typed(spark: SparkSession, path: str, schema: StructType | str, sheet: str | int = 1, **options) -> DataFrame:
    """A sheet as the columns of a schema, by header; cells that can't be converted are null."""
    register(spark)
    return spark.read.format("xlsx").schema(schema).options(mode="wide", path=path, sheet=str(sheet), **options).load()


def read_binary(files: DataFrame, **options) -> DataFrame:
    """CELLS rows of binaryFile rows (path, content): one task parses a file, on any file system that Spark reads."""
    options = {k.lower(): v for k, v in options.items()}

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                if content is None:
                    continue
                book = _open(content, options)
                which = options.get("sheet")
                for i in [book.sheet(which)] if which else range(len(book.sheets)):
                    yield from cell_batches(path, book, i, _flag(options, "failfast", False))

    return files.select("path", "content").mapInArrow(run, CELLS)
