"""Templates, audit text and checksums."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["audit_field", "audit_line", "checksum", "fill_template", "has_placeholder", "split_by_keys"]


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fill_template(text: str | Column, values: Mapping[str, str | Column | None]) -> Column:
    """Each {{Key}} replaced in the mapping's order: a value that holds a later key is filled again, keys without a value stay."""
    out = _c(text)
    for key, value in values.items():
        new = F.coalesce(value, F.lit("")) if isinstance(value, Column) else F.lit(value or "")
        out = F.replace(out, F.lit("{{" + key + "}}"), new)
    return out


def has_placeholder(text: str | Column) -> Column:
    """Whether {{ is followed by }}."""
    return _c(text).rlike(r"(?s)\{\{.*\}\}")


def split_by_keys(text: str | Column, keys: list[str]) -> Column:
    """The text cut at each {{key}}, leftmost first, the keys kept as elements of their own; empty elements go."""
    if not keys:
        return F.array(_c(text))
    pattern = "|".join(re.escape("{{" + k + "}}") for k in keys)
    parts = F.split(F.regexp_replace(_c(text), f"({pattern})", "\u0001$1\u0001"), "\u0001")
    return F.filter(parts, lambda x: x != "")


def audit_field(s: str | Column) -> Column:
    """Null as nothing, tabs and line ends as spaces."""
    return F.translate(F.coalesce(_c(s).cast("string"), F.lit("")), "\t\r\n", "   ")


def audit_line(*fields: str | Column) -> Column:
    """Tab-separated audit fields."""
    return F.concat_ws("\t", *(audit_field(f) for f in fields))


def checksum(data: str | Column) -> Column:
    """CRC-32 with the reversed polynomial 0xEDB88320."""
    return F.crc32(_c(data))
