"""Workbooks written from rows and DataFrames."""

from __future__ import annotations

import datetime as dt
import math
import os
import re
import shutil
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from decimal import Decimal
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from ..functions.codes import password_hash
from ..functions.dates import BUILTIN_FORMATS
from ..operators.export import ExportPlan
from ..operators.rules import Validation
from .package import OFFICE, PackageWriter, escape, quoteattr
from .xlsx import column_index, to_serial

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml."
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
MAX_ROWS = 1_048_576
_EPOCH_DAY = dt.date(1899, 12, 30).toordinal()
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")

#: What a text can hold that doesn't go into a cell as it is.
_SPECIAL = re.compile("[&<>\x00-\x08\x0b-\x1f\ud800-\udfff\ufffe\uffff]|^\\s|\\s\\Z")

#: The same for Arrow, whose white space is ASCII's: an edge of any other character may be some.
_MAY_BE_SPECIAL = r"[&<>\x00-\x08\x0b-\x1f\x{fffe}\x{ffff}]|^[\s\x{80}-\x{10ffff}]|[\s\x{80}-\x{10ffff}]\z"

_TEXT = pa.large_string()

#: Flags of a sheet's protection: what stays allowed.
PROTECTION = ("selectLockedCells", "selectUnlockedCells", "formatCells", "formatColumns", "formatRows", "insertColumns", "insertRows", "insertHyperlinks", "deleteColumns", "deleteRows", "sort", "autoFilter", "pivotTables", "objects", "scenarios")
TABLE_STYLES = {"Light": "TableStyleLight1", "Medium": "TableStyleMedium2", "Dark": "TableStyleDark1", "None": None}


@dataclass(frozen=True)
class CellStyle:
    """Font, fill, border, alignment and number format of a cell."""

    bold: bool = False
    italic: bool = False
    underline: bool = False
    size: float | None = None
    font: str | None = None
    color: str | None = None
    fill: str | None = None
    border: str | None = None
    border_color: str | None = None
    horizontal: str | None = None
    vertical: str | None = None
    wrap: bool = False
    format: str | None = None

    @classmethod
    def of(cls, text: str) -> CellStyle:
        """A style from words: "bold italic underline wrap" and "size:12 font:Arial color:FF0000 fill:EEEEEE border:thin border_color:000000 horizontal:center vertical:top format:0.00" (the format last: it may hold spaces)."""
        text, _, code = text.partition("format:")
        made: dict = {"format": code} if code else {}
        for word in text.split():
            k, colon, v = word.partition(":")
            if k not in cls.__dataclass_fields__ or bool(colon) == (k in ("bold", "italic", "underline", "wrap")):
                raise ValueError(f"not a style: {word!r}")
            made[k] = True if not colon else float(v) if k == "size" else v
        return cls(**made)


@dataclass(frozen=True)
class Formula:
    text: str


@dataclass(frozen=True)
class Link:
    url: str
    display: str | None = None
    tooltip: str | None = None


@dataclass(frozen=True)
class Commented:
    value: object
    text: str
    author: str = ""


@dataclass(frozen=True)
class Styled:
    value: object
    style: CellStyle


@dataclass
class Options:
    inline_strings: bool = False
    date_format: str = "yyyy-mm-dd"
    datetime_format: str = "yyyy-mm-dd hh:mm:ss"
    timespan_format: str = "[h]:mm:ss"
    password: str | None = None
    temp_dir: str | None = None


def column_name(n: int) -> str:
    if not 1 <= n <= 16_384:
        raise ValueError(f"a sheet has no column {n}")
    s = ""
    while n:
        n, k = divmod(n - 1, 26)
        s = chr(65 + k) + s
    return s


def hex_color(c: str) -> str:
    c = c.removeprefix("#")
    if not re.fullmatch("[0-9A-Fa-f]{6}", c):
        raise ValueError(f"not a color: {c!r}")
    return c.upper()


class Styles:
    """Combinations of fonts, fills, borders and formats, each kept once."""

    def __init__(self):
        self.fonts, self.fills, self.borders, self.codes = {"<font><sz val=\"11\"/><name val=\"Calibri\"/></font>": 0}, {'<fill><patternFill patternType="none"/></fill>': 0, '<fill><patternFill patternType="gray125"/></fill>': 1}, {"<border><left/><right/><top/><bottom/><diagonal/></border>": 0}, {}
        self.formats: dict[str, int] = {'<xf numFmtId="0" fontId="0" fillId="0" borderId="0" xfId="0"/>': 0}
        self._known: dict[CellStyle, int] = {CellStyle(): 0}

    def id(self, s: CellStyle) -> int:
        if s in self._known:
            return self._known[s]
        font = "<font>" + "<b/>" * s.bold + "<i/>" * s.italic + "<u/>" * s.underline + f'<sz val="{s.size or 11:g}"/>' + (f'<color rgb="FF{hex_color(s.color)}"/>' if s.color else "") + f"<name val={quoteattr(s.font or 'Calibri')}/></font>"
        fill = f'<fill><patternFill patternType="solid"><fgColor rgb="FF{hex_color(s.fill)}"/><bgColor indexed="64"/></patternFill></fill>' if s.fill else '<fill><patternFill patternType="none"/></fill>'
        side = lambda n: f"<{n} style={quoteattr(s.border)}>" + (f'<color rgb="FF{hex_color(s.border_color)}"/>' if s.border_color else '<color auto="1"/>') + f"</{n}>"
        border = "<border>" + "".join(map(side, ("left", "right", "top", "bottom"))) + "<diagonal/></border>" if s.border else "<border><left/><right/><top/><bottom/><diagonal/></border>"
        put = lambda d, x: d.setdefault(x, len(d))
        code = 0
        if s.format:
            code = BUILTIN_FORMATS.get(s.format)
            code = self.codes.setdefault(s.format, 164 + len(self.codes)) if code is None else code
        align = "".join(f" {k}={quoteattr(v)}" for k, v in (("horizontal", s.horizontal), ("vertical", s.vertical)) if v) + ' wrapText="1"' * s.wrap
        xf = f'<xf numFmtId="{code}" fontId="{put(self.fonts, font)}" fillId="{put(self.fills, fill)}" borderId="{put(self.borders, border)}" xfId="0" applyNumberFormat="1" applyFont="1" applyFill="1" applyBorder="1"' + (f' applyAlignment="1"><alignment{align}/></xf>' if align else "/>")
        self._known[s] = put(self.formats, xf)
        return self._known[s]

    def xml(self) -> str:
        group = lambda n, items: f'<{n} count="{len(items)}">' + "".join(items) + f"</{n}>"
        codes = group("numFmts", [f'<numFmt numFmtId="{i}" formatCode={quoteattr(c)}/>' for c, i in self.codes.items()]) if self.codes else ""
        return f'{_XML}<styleSheet xmlns="{MAIN}">{codes}{group("fonts", self.fonts)}{group("fills", self.fills)}{group("borders", self.borders)}<cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs>{group("cellXfs", self.formats)}<cellStyles count="1"><cellStyle name="Normal" xfId="0" builtinId="0"/></cellStyles></styleSheet>'


@dataclass
class Sheet:
    """What a sheet declares besides its rows; all of it before the first row is written, but for what closes the sheet."""

    name: str
    widths: dict[int, float] = field(default_factory=dict)
    freeze_rows: int = 0
    freeze_columns: int = 0
    merges: list[str] = field(default_factory=list)
    auto_filter: str | None = None
    tables: list[tuple] = field(default_factory=list)
    validations: list[tuple[str, Validation]] = field(default_factory=list)
    conditions: list[tuple[str, dict]] = field(default_factory=list)
    header_footer: dict[str, str] = field(default_factory=dict)
    protection: dict | None = None
    links: list[tuple[str, Link]] = field(default_factory=list)
    comments: list[tuple[str, Commented]] = field(default_factory=list)
    rows: int = 0

    def protect(self, password: str | None = None, **allowed: bool) -> None:
        unknown = set(allowed) - set(PROTECTION)
        if unknown:
            raise ValueError(f"no protection flag {sorted(unknown)[0]!r}")
        self.protection = {"password": password, **{k: allowed.get(k, k.startswith("select")) for k in PROTECTION}}

    def color_scale(self, range_: str, colors: Sequence[str]) -> None:
        self.conditions.append((range_, {"type": "colorScale", "colors": tuple(colors)}))

    def data_bar(self, range_: str, color: str) -> None:
        self.conditions.append((range_, {"type": "dataBar", "color": color}))

    def cell_is(self, range_: str, operator: str, *values) -> None:
        self.conditions.append((range_, {"type": "cellIs", "operator": operator, "values": values}))


class WorkbookWriter:
    """Streams sheets, one after another, into a package."""

    def __init__(self, target, options: Options | None = None):
        self.options = options or Options()
        self.package, self.styles, self.sheets = PackageWriter(target), Styles(), []
        self.strings: dict[str, int] = {}
        self.string_uses = 0
        self.defined_names: dict[str, str] = {}
        self.protection: str | None = None
        self._open = None
        self._letters: list[str] = []
        self._day_style: str | None = None

    def add_sheet(self, sheet: Sheet | str) -> Sheet:
        sheet = Sheet(sheet) if isinstance(sheet, str) else sheet
        n = sheet.name
        if not 1 <= len(n) <= 31 or re.search(r"[:\\/?*\[\]]", n) or n[0] == "'" or n[-1] == "'":
            raise ValueError(f"not a sheet name: {n!r}")
        if any(s.name.lower() == n.lower() for s in self.sheets):
            raise ValueError(f"two sheets {n!r}")
        self._end_sheet()
        self.sheets.append(sheet)
        self._open = self.package.open(f"xl/worksheets/sheet{len(self.sheets)}.xml", _TYPE + "worksheet+xml")
        view = ""
        if sheet.freeze_rows or sheet.freeze_columns:
            at = f"{column_name(sheet.freeze_columns + 1)}{sheet.freeze_rows + 1}"
            split = (f' xSplit="{sheet.freeze_columns}"' if sheet.freeze_columns else "") + (f' ySplit="{sheet.freeze_rows}"' if sheet.freeze_rows else "")
            pane = "bottomRight" if sheet.freeze_rows and sheet.freeze_columns else "bottomLeft" if sheet.freeze_rows else "topRight"
            view = f'<pane{split} topLeftCell="{at}" activePane="{pane}" state="frozen"/>'
        cols = "".join(f'<col min="{i}" max="{i}" width="{w:g}" customWidth="1"/>' for i, w in sorted(sheet.widths.items()))
        self._put(f'{_XML}<worksheet xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheetViews><sheetView workbookViewId="0">{view}</sheetView></sheetViews>' + (f"<cols>{cols}</cols>" if cols else "") + "<sheetData>")
        return sheet

    def _put(self, text: str) -> None:
        self._open.write(text.encode("utf-8", "replace"))

    def write_rows(self, rows: Iterable[Sequence], *, styles: Sequence[CellStyle | None] = ()) -> int:
        """Appends rows; None is an empty cell. Returns their number."""
        sheet, buffer, count, letters = self.sheets[-1], [], 0, self._letters
        plain, isfinite = not any(styles), math.isfinite
        for row in rows:
            sheet.rows += 1
            count += 1
            if sheet.rows > MAX_ROWS:
                raise ValueError(f"a sheet has {MAX_ROWS} rows at most")
            r = sheet.rows
            if len(row) > len(letters):
                letters += [column_name(i) for i in range(len(letters) + 1, len(row) + 1)]
            cells = []
            for i, v in enumerate(row):
                t = type(v)
                if plain and t is int:
                    cells.append(f'<c r="{letters[i]}{r}"><v>{v}</v></c>')
                elif plain and t is str and not _SPECIAL.search(v):
                    cells.append(self._text(v, f"{letters[i]}{r}"))
                elif plain and t is float and isfinite(v):
                    cells.append(f'<c r="{letters[i]}{r}"><v>{v!r}</v></c>')
                elif plain and t is bool:
                    cells.append(f'<c r="{letters[i]}{r}" t="b"><v>{int(v)}</v></c>')
                elif plain and t is dt.date:
                    cells.append(f'<c r="{letters[i]}{r}"{self._day()}><v>{v.toordinal() - _EPOCH_DAY}.0</v></c>')
                elif v is not None or not plain:
                    cells.append(self._cell(v, f"{letters[i]}{r}", styles[i] if i < len(styles) else None))
            buffer.append(f'<row r="{r}">{"".join(cells)}</row>')
            if len(buffer) >= 512:
                self._put("".join(buffer))
                buffer.clear()
        self._put("".join(buffer))
        return count

    def write_batch(self, batch: pa.RecordBatch, *, styles: Sequence[CellStyle | None] = ()) -> int:
        """Appends the rows of a batch, cell by cell of each column at once; returns their number."""
        sheet, n, letters = self.sheets[-1], batch.num_rows, self._letters
        if sheet.rows + n > MAX_ROWS:
            raise ValueError(f"a sheet has {MAX_ROWS} rows at most")
        numbers = pa.array(np.arange(sheet.rows + 1, sheet.rows + n + 1)).cast(_TEXT)
        letters += [column_name(i) for i in range(len(letters) + 1, batch.num_columns + 1)]
        columns = [self._column(batch.column(i), letters[i], numbers, styles[i] if i < len(styles) else None) for i in range(batch.num_columns)]
        rows = _joined('<row r="', numbers, '">', *columns, "</row>")
        if n:
            # the texts of an array lie one after another
            self._open.write(memoryview(rows.buffers()[2])[: int(np.frombuffer(rows.buffers()[1], np.int64, n + 1)[n])])
        sheet.rows += n
        return n

    def _column(self, a: pa.Array, letters: str, numbers: pa.Array, style: CellStyle | None) -> pa.Array:
        """The cells of a column; _cell() says what each looks like."""
        t = a.type
        generic = lambda x, r: pa.array([self._cell(v, letters + k, style) for v, k in zip(x.to_pylist(), r.to_pylist())], _TEXT)
        if style is not None:
            return generic(a, numbers)
        c = f'<c r="{letters}'
        cells = lambda *parts: pc.fill_null(_joined(c, numbers, *parts), "")
        if pa.types.is_integer(t):
            return cells('"><v>', a.cast(_TEXT), "</v></c>")
        if pa.types.is_boolean(t):
            return cells('" t="b"><v>', pc.if_else(a, "1", "0").cast(_TEXT), "</v></c>")
        if pa.types.is_floating(t) or pa.types.is_decimal(t) and t.precision <= 15 and t.scale <= 15:
            values = a.cast(pa.float64())
            if pc.all(pc.is_finite(values), min_count=0).as_py():
                return cells('"><v>', values.cast(_TEXT), "</v></c>")
            return generic(a, numbers)
        if pa.types.is_date(t) or pa.types.is_timestamp(t) and t.tz is None:
            us = a.cast(pa.timestamp("us")).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            serial = pa.array((us + 2_209_161_600_000_000) / 86_400_000_000, mask=a.is_null().to_numpy(zero_copy_only=False))
            day, time = (pa.scalar(f'" s="{self.styles.id(CellStyle(format=f))}"><v>', _TEXT) for f in (self.options.date_format, self.options.datetime_format))
            if abs(us).max(initial=0) < 2**52:
                return cells(pc.if_else(pa.array(us % 86_400_000_000 == 0), day, time), serial.cast(_TEXT), "</v></c>")
            return generic(a, numbers)
        if pa.types.is_string(t) or pa.types.is_large_string(t):
            if not self.options.inline_strings:
                self.string_uses += len(a) - a.null_count
                d = a.dictionary_encode()
                ids = pa.array([self.strings.setdefault(_BAD.sub("", v), len(self.strings)) for v in d.dictionary.to_pylist()], pa.int64())
                return cells('" t="s"><v>', ids.take(d.indices).cast(_TEXT), "</v></c>")
            out = cells('" t="inlineStr"><is><t>', a.cast(_TEXT), "</t></is></c>")
            special = pc.fill_null(pc.match_substring_regex(a, _MAY_BE_SPECIAL), False)
            if pc.any(special, min_count=0).as_py():
                out = pc.replace_with_mask(out, special, generic(a.filter(special), numbers.filter(special)))
            return out
        return generic(a, numbers)

    def _day(self) -> str:
        """The style attribute of a date."""
        if self._day_style is None:
            self._day_style = f' s="{self.styles.id(CellStyle(format=self.options.date_format))}"'
        return self._day_style

    def _text(self, v: str, at: str) -> str:
        """The cell of a text without special characters."""
        if self.options.inline_strings:
            return f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
        self.string_uses += 1
        return f'<c r="{at}" t="s"><v>{self.strings.setdefault(v, len(self.strings))}</v></c>'

    def skip_rows(self, n: int) -> None:
        self.sheets[-1].rows += n

    def _cell(self, v, at: str, style: CellStyle | None) -> str:
        if isinstance(v, Styled):
            return self._cell(v.value, at, v.style)
        if isinstance(v, Commented):
            self.sheets[-1].comments.append((at, v))
            return self._cell(v.value, at, style)
        if isinstance(v, Link):
            self.sheets[-1].links.append((at, v))
            return self._cell(v.display or v.url, at, style)

        def s(default: str | None = None) -> str:
            x = style or (CellStyle(format=default) if default else None)
            i = self.styles.id(x) if x else 0
            return f' s="{i}"' if i else ""

        if v is None:
            return f'<c r="{at}"{s()}/>' if style else ""
        if isinstance(v, Formula):
            return f'<c r="{at}"{s()}><f>{escape(v.text.removeprefix("="))}</f></c>'
        if isinstance(v, bool):
            return f'<c r="{at}"{s()} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, dt.datetime):
            o = self.options
            return f'<c r="{at}"{s(o.date_format if v.time() == dt.time() else o.datetime_format)}><v>{to_serial(v)!r}</v></c>'
        if isinstance(v, dt.date):
            return f'<c r="{at}"{s(self.options.date_format)}><v>{to_serial(v)!r}</v></c>'
        if isinstance(v, dt.timedelta):
            return f'<c r="{at}"{s(self.options.timespan_format)}><v>{to_serial(v)!r}</v></c>'
        if isinstance(v, (int, float, Decimal)):
            x = v if isinstance(v, int) else float(v)
            if isinstance(x, int) or math.isfinite(x):
                return f'<c r="{at}"{s()}><v>{x!r}</v></c>'
            v = str(v)
        text = _BAD.sub("", v if isinstance(v, str) else str(v))
        keep = ' xml:space="preserve"' if text != text.strip() else ""
        if self.options.inline_strings:
            return f'<c r="{at}"{s()} t="inlineStr"><is><t{keep}>{escape(text)}</t></is></c>'
        self.string_uses += 1
        return f'<c r="{at}"{s()} t="s"><v>{self.strings.setdefault(text, len(self.strings))}</v></c>'

    def _end_sheet(self) -> None:
        """What follows a sheet's rows, in the schema's order."""
        if self._open is None:
            return
        sheet, n = self.sheets[-1], len(self.sheets)
        part = f"xl/worksheets/sheet{n}.xml"
        out = ["</sheetData>"]
        if sheet.protection is not None:
            p = dict(sheet.protection)
            password = p.pop("password")
            hash_ = "".join(f' {k}="{v}"' for k, v in password_hash(password).items()) if password else ""
            out.append(f'<sheetProtection{hash_} sheet="1"' + "".join(f' {k}="{int(not v)}"' for k, v in p.items()) + "/>")
        if sheet.auto_filter:
            out.append(f"<autoFilter ref={quoteattr(sheet.auto_filter)}/>")
        if sheet.merges:
            out.append(f'<mergeCells count="{len(sheet.merges)}">' + "".join(f"<mergeCell ref={quoteattr(m)}/>" for m in sheet.merges) + "</mergeCells>")
        for i, (ref, c) in enumerate(sheet.conditions, 1):
            out.append(f"<conditionalFormatting sqref={quoteattr(ref)}>{_condition(c, i)}</conditionalFormatting>")
        if sheet.validations:
            out.append(f'<dataValidations count="{len(sheet.validations)}">' + "".join(_validation(ref, v) for ref, v in sheet.validations) + "</dataValidations>")
        if sheet.links:
            rows = []
            for ref, x in sheet.links:
                tip = f" tooltip={quoteattr(x.tooltip)}" if x.tooltip else ""
                if x.url.startswith("#"):
                    rows.append(f"<hyperlink ref={quoteattr(ref)} location={quoteattr(x.url[1:])}{tip}/>")
                else:
                    rows.append(f'<hyperlink ref={quoteattr(ref)} r:id="{self.package.relate(part, "hyperlink", x.url, external=True)}"{tip}/>')
            out.append("<hyperlinks>" + "".join(rows) + "</hyperlinks>")
        if sheet.header_footer:
            hf = sheet.header_footer
            side = lambda k: "".join(f"&{c}{hf[k + n]}" for c, n in (("L", "_left"), ("C", "_center"), ("R", "_right")) if hf.get(k + n))
            out.append("<headerFooter>" + "".join(f"<{tag}>{escape(side(k))}</{tag}>" for k, tag in (("header", "oddHeader"), ("footer", "oddFooter")) if side(k)) + "</headerFooter>")
        if sheet.comments:
            out.append(f'<legacyDrawing r:id="{self.package.relate(part, "vmlDrawing", f"../drawings/vmlDrawing{n}.vml")}"/>')
            self.package.relate(part, "comments", f"../comments{n}.xml")
        names = [self.package.relate(part, "table", f"../tables/table{n}_{k}.xml") for k in range(len(sheet.tables))]
        if names:
            out.append(f'<tableParts count="{len(names)}">' + "".join(f'<tablePart r:id="{i}"/>' for i in names) + "</tableParts>")
        self._put("".join(out) + "</worksheet>")
        self._open.close()
        self._open = None
        for k, (ref, name, headers, style) in enumerate(sheet.tables):
            cols = "".join(f'<tableColumn id="{i}" name={quoteattr(h)}/>' for i, h in enumerate(headers, 1))
            look = f"<tableStyleInfo name={quoteattr(style)} showFirstColumn=\"0\" showLastColumn=\"0\" showRowStripes=\"1\" showColumnStripes=\"0\"/>" if style else ""
            self.package.add(f"xl/tables/table{n}_{k}.xml", _TYPE + "table+xml", f'{_XML}<table xmlns="{MAIN}" id="{n * 100 + k + 1}" name={quoteattr(name)} displayName={quoteattr(name)} ref={quoteattr(ref)}><autoFilter ref={quoteattr(ref)}/><tableColumns count="{len(headers)}">{cols}</tableColumns>{look}</table>')
        if sheet.comments:
            authors = list(dict.fromkeys(c.author for _, c in sheet.comments))
            body = "".join(f'<comment ref={quoteattr(ref)} authorId="{authors.index(c.author)}"><text><r><t xml:space="preserve">{escape(c.text)}</t></r></text></comment>' for ref, c in sheet.comments)
            self.package.add(f"xl/comments{n}.xml", _TYPE + "comments+xml", f'{_XML}<comments xmlns="{MAIN}"><authors>' + "".join(f"<author>{escape(a)}</author>" for a in authors) + f"</authors><commentList>{body}</commentList></comments>")
            boxes = ""
            for k, (ref, _) in enumerate(sheet.comments):
                col, row = column_index(ref)
                boxes += f'<v:shape id="_x0000_s{1025 + k}" type="#_x0000_t202" style="position:absolute;visibility:hidden" fillcolor="#ffffe1"><x:ClientData ObjectType="Note"><x:Row>{row - 1}</x:Row><x:Column>{col - 1}</x:Column></x:ClientData></v:shape>'
            self.package.add(f"xl/drawings/vmlDrawing{n}.vml", "application/vnd.openxmlformats-officedocument.vmlDrawing", f'<xml xmlns:v="urn:schemas-microsoft-com:vml" xmlns:o="urn:schemas-microsoft-com:office:office" xmlns:x="urn:schemas-microsoft-com:office:excel"><v:shapetype id="_x0000_t202" coordsize="21600,21600" o:spt="202" path="m,l,21600r21600,l21600,xe"/>{boxes}</xml>')

    def define_name(self, name: str, refers_to: str) -> None:
        if not re.fullmatch(r"[^\W\d][\w.]*", name):
            raise ValueError(f"not a name: {name!r}")
        if any(n.lower() == name.lower() for n in self.defined_names):
            raise ValueError(f"two names {name!r}")
        self.defined_names[name] = refers_to

    def close(self) -> None:
        if not self.sheets:
            raise ValueError("a workbook has one sheet at least")
        self._end_sheet()
        for i in range(len(self.sheets)):
            self.package.relate("xl/workbook.xml", "worksheet", f"worksheets/sheet{i + 1}.xml")
        self.package.relate("xl/workbook.xml", "styles", "styles.xml")
        self.package.add("xl/styles.xml", _TYPE + "styles+xml", self.styles.xml())
        if self.strings:
            items = "".join("<si><t" + (' xml:space="preserve"' if t != t.strip() else "") + f">{escape(t)}</t></si>" for t in self.strings)
            self.package.relate("xl/workbook.xml", "sharedStrings", "sharedStrings.xml")
            self.package.add("xl/sharedStrings.xml", _TYPE + "sharedStrings+xml", f'{_XML}<sst xmlns="{MAIN}" count="{self.string_uses}" uniqueCount="{len(self.strings)}">{items}</sst>')
        lock = ""
        if self.protection is not None:
            h = password_hash(self.protection) if self.protection else {}
            lock = '<workbookProtection lockStructure="1"' + "".join(f' workbook{k[0].upper()}{k[1:]}="{v}"' for k, v in h.items()) + "/>"
        sheets = "".join(f'<sheet name={quoteattr(s.name)} sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(self.sheets, 1))
        names = "".join(f"<definedName name={quoteattr(n)}>{escape(v)}</definedName>" for n, v in self.defined_names.items())
        self.package.add("xl/workbook.xml", _TYPE + "sheet.main+xml", f'{_XML}<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}">{lock}<sheets>{sheets}</sheets>' + (f"<definedNames>{names}</definedNames>" if names else "") + "</workbook>")
        self.package.relate("", "officeDocument", "xl/workbook.xml")
        self.package.close()


def _condition(c: dict, priority: int) -> str:
    if c["type"] == "colorScale":
        return f'<cfRule type="colorScale" priority="{priority}"><colorScale><cfvo type="min"/><cfvo type="percentile" val="50"/><cfvo type="max"/>' + "".join(f'<color rgb="FF{hex_color(x)}"/>' for x in c["colors"]) + "</colorScale></cfRule>"
    if c["type"] == "dataBar":
        return f'<cfRule type="dataBar" priority="{priority}"><dataBar><cfvo type="min"/><cfvo type="max"/><color rgb="FF{hex_color(c["color"])}"/></dataBar></cfRule>'
    return f'<cfRule type="cellIs" priority="{priority}" operator={quoteattr(c["operator"])}>' + "".join(f"<formula>{escape(str(v))}</formula>" for v in c["values"]) + "</cfRule>"


def _validation(ref: str, v: Validation) -> str:
    kind = {"list": "list", "range": "list", "length": "textLength"}.get(v.kind, v.kind)
    head = f'<dataValidation type="{kind}" allowBlank="{int(v.allow_blank)}" showErrorMessage="1" sqref={quoteattr(ref)}'
    if v.kind == "list":
        body = ",".join(v.values).replace('"', '""')
        return f"{head}><formula1>{escape(chr(34) + body + chr(34))}</formula1></dataValidation>"
    if v.kind == "range":
        return f"{head}><formula1>{escape(v.reference)}</formula1></dataValidation>"
    op, a, b = v.bounds()
    num = lambda x: str(to_serial(x)) if isinstance(x, (dt.date, dt.datetime)) else str(x)
    return f'{head} operator="{op}"><formula1>{escape(num(a))}</formula1>' + (f"<formula2>{escape(num(b))}</formula2>" if b is not None else "") + "</dataValidation>"


def _joined(*parts: str | pa.Array) -> pa.Array:
    """Texts joined row by row; null where any of them is."""
    return pc.binary_join_element_wise(*(pa.scalar(x, _TEXT) if isinstance(x, str) else x for x in parts), pa.scalar("", _TEXT))


def _rows(df: DataFrame) -> Iterable[Sequence]:
    return df.toLocalIterator(prefetchPartitions=True)


@contextmanager
def _spooled(path: str, options: Options) -> Iterator[BinaryIO]:
    """A file that takes the place of `path` once it is whole, encrypted if there is a password; nothing else stays."""
    folder = options.temp_dir or os.path.dirname(os.path.abspath(path))
    temp = os.path.join(folder, f".{uuid.uuid4().hex}.tmp")
    near = os.path.join(os.path.dirname(os.path.abspath(path)), f".{uuid.uuid4().hex}.tmp")
    try:
        with open(temp, "wb") as f:
            yield f
        if options.password:
            from .encryption import encrypt

            with open(temp, "rb") as f:
                data = encrypt(f.read(), options.password)
            with open(near, "wb") as f:
                f.write(data)
        else:
            shutil.move(temp, near)
        os.replace(near, path)
    finally:
        for t in (temp, near):
            if os.path.exists(t):
                os.remove(t)


def _style_of(c) -> CellStyle | None:
    """A planned column's style and format."""
    style = CellStyle.of(c.style) if isinstance(c.style, str) else c.style
    return replace(style or CellStyle(), format=c.format) if c.format else style


def write_workbook(path: str, sheets: dict[str, DataFrame] | DataFrame, *, plans: dict[str, ExportPlan] | ExportPlan | None = None, options: Options | None = None, headers: bool = True) -> dict[str, int]:
    """One workbook from DataFrames, streamed through the driver row by row; returns the rows written to each sheet.

    For output beyond a workbook's size write ``df.write.format("xlsx")``: each task writes its own file.
    """
    if isinstance(sheets, DataFrame):
        sheets = {(plans.sheet if isinstance(plans, ExportPlan) else "Sheet1"): sheets}
    if not sheets:
        raise ValueError("a workbook has one sheet at least")
    options = options or Options()
    counts = {}
    with _spooled(path, options) as f:
        w = WorkbookWriter(f, options)
        for name, df in sheets.items():
            plan = (plans.get(name) if isinstance(plans, dict) else plans) or ExportPlan()
            cols = plan.resolved(df)
            sheet = Sheet(name, {i: c.width for i, c in enumerate(cols, 1) if c.width}, freeze_rows=plan.freeze_rows, header_footer=plan.header_footer)
            w.add_sheet(sheet)
            if headers:
                w.write_rows([[c.header for c in cols]], styles=[CellStyle(bold=True)] * len(cols))
            counts[name] = w.write_rows(_rows(plan.project(df)), styles=[_style_of(c) for c in cols])
            area = f"A1:{column_name(max(1, len(cols)))}{max(1, sheet.rows)}"
            if plan.as_table:
                sheet.tables.append((area, re.sub(r"\W", "_", name), [c.header for c in cols], TABLE_STYLES.get(plan.as_table, plan.as_table)))
            elif plan.auto_filter:
                sheet.auto_filter = area
        w.close()
    return counts


def write_cells(path: str, cells: DataFrame, *, defined_names: dict[str, str] | None = None, options: Options | None = None) -> None:
    """A workbook from the sparse model (sheet, row, col, value, formula): rows and columns that are missing stay empty."""
    with _spooled(path, options or Options()) as f:
        w = WorkbookWriter(f, options)
        current, row, held = None, None, {}

        def flush():
            if row is not None:
                w.skip_rows(row - w.sheets[-1].rows - 1)
                w.write_rows([[held.get(c) for c in range(1, max(held) + 1)]])

        for r in _rows(cells.select("sheet", "row", "col", "value", "formula").orderBy("sheet", "row", "col")):
            if r.sheet != current:
                flush()
                w.add_sheet(r.sheet)
                current, row, held = r.sheet, None, {}
            if r.row != row:
                flush()
                row, held = r.row, {}
            held[r.col] = Formula(r.formula) if r.formula is not None else r.value
        flush()
        for n, v in (defined_names or {}).items():
            w.define_name(n, v)
        w.close()


def balanced(df: DataFrame, rows_per_file: int = 65_536) -> DataFrame:
    """df in as many partitions as it takes for some `rows_per_file` rows in each: one task writes, and one reads, a workbook."""
    n = df.select(F.lit(1)).count()
    return df.repartition(max(1, -(-n // rows_per_file)))


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class XlsxDataWriter(DataSourceArrowWriter):
    """Workbooks for each task, under temporary names until the job commits: the next one begins where a sheet's rows end.

    Options: ``sheet``, ``header``, ``useInlineStrings``, ``dateFormat``, ``datetimeFormat``, ``timespanFormat``, ``password``, ``tempDir`` and ``maxRowsPerFile``;
    width, format and style of a column are taken from its metadata, where an ExportPlan's project() leaves them.
    """

    def __init__(self, schema, options: dict, overwrite: bool):
        self.schema, self.overwrite = schema, overwrite
        options = {k.lower(): v for k, v in options.items()}
        self.folder = options["path"].removeprefix("file://")
        self.sheet = options.get("sheet", "Sheet1")
        self.headers = options.get("header", "true").lower() == "true"
        self.options = Options(
            inline_strings=options.get("useinlinestrings", "true").lower() == "true",
            date_format=options.get("dateformat", Options.date_format),
            datetime_format=options.get("datetimeformat", Options.datetime_format),
            timespan_format=options.get("timespanformat", Options.timespan_format),
            password=options.get("password"),
            temp_dir=options.get("tempdir"),
        )
        self.rows = min(MAX_ROWS - self.headers, int(options.get("maxrowsperfile", MAX_ROWS)))

    def write(self, iterator):
        os.makedirs(self.folder, exist_ok=True)
        files: list[tuple[str, str]] = []
        try:
            batches, rest = _gathered(iterator), None
            while True:
                name = uuid.uuid4().hex
                temp = os.path.join(self.folder, f".{name}.tmp")
                files.append((temp, os.path.join(self.folder, f"part-{name}.xlsx")))
                with _spooled(temp, self.options) as f:
                    rest = self._workbook(f, batches, rest)
                if rest is None:
                    return _Written(files)
        except BaseException:
            _remove(temp for temp, _ in files)
            raise

    def _workbook(self, f, batches, rest):
        """Writes one workbook; returns the batch that the next begins with, if there is one."""
        fields = [(c.name, c.metadata or {}) for c in self.schema.fields]
        w = WorkbookWriter(f, self.options)
        w.add_sheet(Sheet(self.sheet, {i: m["width"] for i, (_, m) in enumerate(fields, 1) if m.get("width")}))
        if self.headers:
            w.write_rows([[n for n, _ in fields]], styles=[CellStyle(bold=True)] * len(fields))
        styles = [replace(CellStyle.of(m.get("style", "")), **({"format": m["format"]} if m.get("format") else {})) if m.get("style") or m.get("format") else None for _, m in fields]
        left = self.rows
        while left:
            batch = rest if rest is not None else next(batches, None)
            if batch is None:
                break
            w.write_batch(batch.slice(0, left), styles=styles)
            rest = batch.slice(left) if batch.num_rows > left else None
            left -= min(left, batch.num_rows)
        w.close()
        return rest if rest is not None else next(batches, None)

    def commit(self, messages):
        files = [x for m in messages if m is not None for x in m.files]
        new = {os.path.basename(final) for _, final in files}
        for temp, final in files:
            os.replace(temp, final)
        if self.overwrite:
            _remove(os.path.join(self.folder, f) for f in os.listdir(self.folder) if f.endswith(".xlsx") and f not in new)

    def abort(self, messages):
        _remove(temp for m in messages if m is not None for temp, _ in m.files)


def _gathered(batches: Iterable[pa.RecordBatch], rows: int = 8_192, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Small batches joined up to some rows and bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if held and (sum(x.num_rows for x in held) + b.num_rows > rows or sum(x.nbytes for x in held) + b.nbytes > size):
            yield pa.concat_batches(held)
            held = []
        held.append(b)
    if held:
        yield pa.concat_batches(held)


def _remove(paths: Iterable[str]) -> None:
    for p in paths:
        if os.path.exists(p):
            os.remove(p)


__all__ = ["CellStyle", "Commented", "Formula", "Link", "Options", "Sheet", "Styled", "WorkbookWriter", "XlsxDataWriter", "balanced", "write_cells", "write_workbook"]
