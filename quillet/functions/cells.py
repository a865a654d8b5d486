"""Cell addresses and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_COLUMNS, MAX_ROWS = 16_384, 1_048_576

__all__ = ["MAX_COLUMNS", "MAX_ROWS", "a1", "a1_column", "a1_row", "bool_cell", "cell_kind", "column_letters", "column_number", "edge_whitespace", "half_even_int", "hex_color", "is_defined_name", "is_sheet_name", "number_or_text", "to_kind", "unsafe_entry"]


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def column_letters(n: str | Column) -> Column:
    """1 -> A, 27 -> AA, 16384 -> XFD; null outside 1 .. 16384."""
    n = _c(n).cast("int")
    letter = lambda k: F.char(F.lit(65) + k)
    one = letter(F.pmod(n - 1, F.lit(26)))
    two = letter(F.pmod(F.floor((n - 27) / 26), F.lit(26)))
    three = letter(F.pmod(F.floor((n - 703) / 676), F.lit(26)))
    text = F.concat(F.when(n > 702, three).otherwise(""), F.when(n > 26, two).otherwise(""), one)
    return F.when(n.between(1, MAX_COLUMNS), text)


def column_number(letters: str | Column) -> Column:
    """The number of a column's letters, in either case; null for anything else."""
    s = F.upper(_c(letters))
    n = F.aggregate(F.split(s, ""), F.lit(0).cast("long"), lambda a, x: F.when(x == "", a).otherwise(a * 26 + F.ascii(x) - 64))
    return F.when(s.rlike("^[A-Z]{1,3}$"), n.cast("int"))


def a1(row: str | Column, column: str | Column, *, rows: int | None = MAX_ROWS) -> Column:
    """The address of a cell; null where a sheet of so many rows (None: any number) has no such cell."""
    r = _c(row).cast("long")
    return F.when(r >= 1 if rows is None else r.between(1, rows), F.concat(column_letters(column), r.cast("string")))


def a1_row(address: str | Column) -> Column:
    """The row of an address such as B12; null if it isn't one."""
    return F.expr("int(null)") if address is None else F.when(_c(address).rlike("^[A-Za-z]{1,3}[1-9][0-9]*$"), F.regexp_extract(_c(address), "([0-9]+)$", 1).try_cast("int"))


def a1_column(address: str | Column) -> Column:
    """The column of an address; the row may be missing, as in a cell reference's prefix."""
    return column_number(F.regexp_extract(_c(address), "^([A-Za-z]+)", 1))


def bool_cell(raw: str | Column) -> Column:
    """Only 1 is true."""
    return _c(raw) == "1"


def number_or_text(raw: str | Column) -> Column:
    """struct(number, text): the number if the text is one, else the text."""
    n = _c(raw).try_cast("double")
    return F.struct(n.alias("number"), F.when(n.isNull(), _c(raw)).alias("text"))


def cell_kind(raw: str | Column, kind: str | Column) -> Column:
    """How a raw cell with type attribute `kind` is read: string, bool, error, date or number."""
    k = F.coalesce(_c(kind), F.lit("n"))
    return (
        F.when(k.isin("s", "str", "inlineStr"), "string")
        .when(k == "b", "bool")
        .when(k == "e", "error")
        .when(k == "d", F.when(_c(raw).try_cast("timestamp_ntz").isNotNull(), "date").otherwise("string"))
        .otherwise(F.when(_c(raw).try_cast("double").isNotNull(), "number").otherwise("string"))
    )


def half_even_int(x: str | Column, kind: str = "int") -> Column:
    """A double as an integer, halves going to the even one; null outside the type."""
    return F.bround(_c(x), 0).try_cast(kind)


def to_kind(x: str | Column, kind: str, default=None) -> Column:
    """A text or number as `kind`, or the default where it can't be: a typed read that skips bad cells."""
    c = _c(x)
    if kind in ("tinyint", "smallint", "int", "bigint", "long"):
        out = half_even_int(c.try_cast("double"), kind)
    elif kind == "boolean":
        out = F.coalesce(c.try_cast("double") != 0, c.cast("string").try_cast("boolean"))
    else:
        out = c.try_cast(kind)
    return out if default is None else F.coalesce(out, F.lit(default).cast(kind))


def edge_whitespace(s: str | Column) -> Column:
    """Whether white space begins or ends the text, so that XML must preserve it."""
    return _c(s).rlike(r"^\s|\s$")


def hex_color(s: str | Column) -> Column:
    """Six hexadecimal digits in upper case, without a leading #; an error for anything else; null stays null."""
    h = F.upper(F.regexp_replace(_c(s), "^#", ""))
    return F.when(_c(s).isNull(), F.lit(None).cast("string")).when(h.rlike("^[0-9A-F]{6}$"), h).otherwise(F.raise_error(F.concat(F.lit("not a color: "), _c(s))).cast("string"))


def is_sheet_name(s: str | Column) -> Column:
    """1 to 31 characters, none of : \\ / ? * [ ], no apostrophe at an edge."""
    c = _c(s)
    return F.length(c).between(1, 31) & ~c.rlike(r"[:\\/?*\[\]]") & ~c.rlike("^'|'$")


def is_defined_name(s: str | Column) -> Column:
    """A letter or _, then letters, digits, _ and dots."""
    return _c(s).rlike(r"^[\p{L}_][\p{L}\p{Nd}_.]*$")


def unsafe_entry(name: str | Column) -> Column:
    """Whether an archive entry's name is absolute, names a drive or climbs out of its folder."""
    n = F.translate(_c(name), "\\", "/")
    return (F.trim(n) == "") | n.startswith("/") | n.rlike("^[A-Za-z]:") | F.array_contains(F.split(n, "/"), "..")
