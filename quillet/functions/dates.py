"""Serial dates and date formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["BUILTIN_FORMATS", "format_code_id", "from_serial", "is_date_format", "is_date_format_column", "iso_instant", "serial"]

_DAY_MS = 86_400_000
_BUILTIN_DATES = frozenset([*range(14, 23), 45, 46, 47])

#: Ids that number-format codes have without being declared.
BUILTIN_FORMATS = {"General": 0, "0": 1, "0.00": 2, "#,##0": 3, "#,##0.00": 4, "0%": 9, "0.00%": 10, "0.00E+00": 11, "# ?/?": 12, "# ??/??": 13, "m/d/yyyy": 14, "d-mmm-yy": 15, "d-mmm": 16, "mmm-yy": 17, "h:mm AM/PM": 18, "h:mm:ss AM/PM": 19, "h:mm": 20, "h:mm:ss": 21, "m/d/yyyy h:mm": 22, "#,##0 ;(#,##0)": 37, "#,##0 ;[Red](#,##0)": 38, "#,##0.00;(#,##0.00)": 39, "#,##0.00;[Red](#,##0.00)": 40, "mm:ss": 45, "[h]:mm:ss": 46, "mmss.0": 47, "##0.0E+0": 48, "@": 49}


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def format_code_id(code: str | Column) -> Column:
    """A code's built-in id, or null."""
    pairs = [F.lit(x) for kv in BUILTIN_FORMATS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), _c(code))


def serial(ts: str | Column) -> Column:
    """Days since 1899-12-30, with the time as a fraction."""
    return F.timestamp_diff("MILLISECOND", F.lit("1899-12-30").cast("timestamp_ntz"), _c(ts).cast("timestamp_ntz")) / F.lit(_DAY_MS)


def from_serial(days: str | Column, date1904: bool = False) -> Column:
    """The time of a serial number, to the millisecond; null outside the years 100 to 9999."""
    d = _c(days) + F.lit(1462 if date1904 else 0)
    ms = F.round(d * F.lit(_DAY_MS)).cast("long")
    return F.when(d.between(-657434, 2958465.99999999), F.timestamp_add("MILLISECOND", ms, F.lit("1899-12-30").cast("timestamp_ntz")))


def iso_instant(ts: str | Column) -> Column:
    """ISO 8601 with seven digits of a second, as audit lines have it."""
    t = _c(ts)
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0"))


def is_date_format(format_id: int, code: str | None) -> bool:
    """Whether numbers with this format are dates, times or durations."""
    if format_id in _BUILTIN_DATES:
        return True
    if 0 < format_id < 164 or not code:
        return False
    if re.search(r"\[(?:h+|m+|s+)\]", code, re.I):
        return True
    bare = re.sub(r"\"[^\"]*\"?|\\.|_.|\*.|\[[^\]]*\]", "", code)
    return re.search(r"[ymdhs]", re.sub(r"general", "", bare, flags=re.I), re.I) is not None


def is_date_format_column(format_id: str | Column, code: str | Column) -> Column:
    """is_date_format as a column expression."""
    i, c = _c(format_id), F.coalesce(_c(code), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(c, r'"[^"]*"?|\\.|_.|\*.|\[[^\]]*\]', ""), "(?i)general", "")
    return i.isin(*sorted(_BUILTIN_DATES)) | (~((i > 0) & (i < 164)) & (c.rlike(r"(?i)\[(?:h+|m+|s+)\]") | bare.rlike("(?i)[ymdhs]")))
