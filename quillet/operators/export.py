"""Export plans: which columns go out, under which names, in which order and format."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import serial


@dataclass(frozen=True)
class ColumnPlan:
    """One output column; order None goes by declaration."""

    source: str
    header: str | None = None
    width: float | None = None
    format: str | None = None
    style: str | None = None
    order: int = 0
    ignored: bool = False


@dataclass(frozen=True)
class ExportPlan:
    """A plan built step by step; each step returns a new plan, and the later of two settings wins where it isn't None."""

    columns: dict[str, ColumnPlan] = field(default_factory=dict)
    sheet: str = "Sheet1"
    freeze_rows: int = 0
    auto_filter: bool = False
    as_table: str | None = None
    header_footer: dict[str, str] = field(default_factory=dict)

    def column(self, source: str, *, header: str | None = None, width: float | None = None, format: str | None = None, style: str | None = None, order: int | None = None) -> ExportPlan:
        """Declares a column; `style` is in words, as CellStyle.of() reads them: "bold fill:FFEE00"."""
        if not isinstance(source, str):
            raise TypeError("a column is named by a string")
        old = self.columns.get(source, ColumnPlan(source))
        changes = {k: v for k, v in {"header": header, "width": width, "format": format, "style": style, "order": order}.items() if v is not None}
        return replace(self, columns={**self.columns, source: replace(old, **changes)})

    def ignore(self, *sources: str) -> ExportPlan:
        return replace(self, columns={**self.columns, **{s: replace(self.columns.get(s, ColumnPlan(s)), ignored=True) for s in sources}})

    def named(self, sheet: str) -> ExportPlan:
        return replace(self, sheet=sheet)

    def resolved(self, df: DataFrame) -> list[ColumnPlan]:
        """The columns that go out: by order, then as declared in df.  Metadata of a field (header, width, format, order, ignore) counts where the plan is silent."""
        unknown = [c for c in self.columns if c not in df.columns]
        if unknown:
            raise ValueError(f"no column {unknown[0]!r}")
        out = []
        for f in df.schema:
            p, m = self.columns.get(f.name, ColumnPlan(f.name)), f.metadata or {}
            p = replace(p, header=p.header or m.get("header") or f.name, width=p.width or m.get("width"), format=p.format or m.get("format"), style=p.style or m.get("style"), order=p.order or m.get("order", 0), ignored=p.ignored or m.get("ignore", False))
            if not p.ignored:
                out.append(p)
        return sorted(out, key=lambda p: p.order)

    def project(self, df: DataFrame, *, serial_dates: bool = False) -> DataFrame:
        """df with the plan's columns, renamed and in order; dates as serial numbers if asked for."""
        kinds = dict(df.dtypes)
        cols = []
        for p in self.resolved(df):
            c = df[p.source]
            if serial_dates and kinds[p.source] in ("timestamp", "timestamp_ntz", "date"):
                c = serial(c)
            cols.append(c.alias(p.header, metadata={k: v for k, v in {"width": p.width, "format": p.format, "style": p.style}.items() if v is not None}))
        return df.select(*cols)


def non_null_rows(df: DataFrame) -> DataFrame:
    """Rows that hold anything: a row of nulls is a missing item."""
    return df.where(F.coalesce(*[F.when(df[c].isNotNull(), True) for c in df.columns], F.lit(False)))


def pick(df: DataFrame, *names: str | int) -> DataFrame:
    """Columns by header (in either case) or place; null where there is none."""
    lower: dict[str, str] = {}
    for c in df.columns:
        lower.setdefault(c.lower(), c)
    out: list[Column] = []
    for n in names:
        c = (df.columns[n] if 0 <= n < len(df.columns) else None) if isinstance(n, int) else lower.get(n.lower())
        out.append((df[c] if c else F.lit(None).cast("string")).alias(str(n)))
    return df.select(*out)


def with_sheet_name(sheets: dict[str, DataFrame]) -> DataFrame:
    """All sheets in one table, with the sheet's name; columns that a sheet lacks are null."""
    if not sheets:
        raise ValueError("no sheets")
    frames = [df.withColumn("sheet", F.lit(name)) for name, df in sheets.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def first_headers(names: Iterable[str]) -> dict[str, int]:
    """Places of headers by lower-case name: the first of equal ones, empty ones not at all."""
    out: dict[str, int] = {}
    for i, n in enumerate(names):
        if isinstance(n, str) and n:
            out.setdefault(n.lower(), i)
    return out
