"""Validation rules and conditional formats, evaluated as column expressions.

A workbook only declares these; here they are predicates and scales over DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class Validation:
    """A rule on one column; a blank value passes if blanks are allowed."""

    kind: str
    values: tuple = ()
    low: float | str | None = None
    high: float | str | None = None
    reference: str | None = None
    allow_blank: bool = True

    @classmethod
    def list(cls, *values: str, allow_blank: bool = True) -> Validation:
        if len(",".join(values)) > 255:
            raise ValueError("a list rule holds at most 255 characters")
        return cls("list", values, allow_blank=allow_blank)

    @classmethod
    def list_from_range(cls, reference: str, allow_blank: bool = True) -> Validation:
        return cls("range", reference=reference, allow_blank=allow_blank)

    @classmethod
    def whole_number(cls, low=None, high=None, allow_blank: bool = True) -> Validation:
        return cls("whole", low=low, high=high, allow_blank=allow_blank)

    @classmethod
    def decimal_number(cls, low=None, high=None, allow_blank: bool = True) -> Validation:
        return cls("decimal", low=low, high=high, allow_blank=allow_blank)

    @classmethod
    def date(cls, low=None, high=None, allow_blank: bool = True) -> Validation:
        return cls("date", low=low, high=high, allow_blank=allow_blank)

    @classmethod
    def text_length(cls, low=None, high=None, allow_blank: bool = True) -> Validation:
        return cls("length", low=low, high=high, allow_blank=allow_blank)

    def bounds(self) -> tuple:
        """(operator, low, high) as declared; without any bound it is between 0 and 0."""
        if self.low is not None and self.high is not None:
            return "between", self.low, self.high
        if self.low is not None:
            return "greaterThanOrEqual", self.low, None
        if self.high is not None:
            return "lessThanOrEqual", self.high, None
        return "between", 0, 0

    def holds(self, column: str | Column) -> Column:
        """Whether a value passes; never null."""
        c = _c(column)
        if self.kind == "list":
            ok = c.cast("string").isin(*self.values)
        elif self.kind == "range":
            raise ValueError("a range rule needs valid_rows(), with the range's values")
        else:
            x = F.length(c) if self.kind == "length" else c
            op, low, high = self.bounds()
            if self.kind == "date":
                low, high = (None if v is None else F.lit(str(v)).cast("timestamp_ntz") if v != 0 else F.lit("1899-12-30").cast("timestamp_ntz") for v in (low, high))
                x = x.cast("timestamp_ntz")
            ok = x.between(low, high) if op == "between" else x >= low if op == "greaterThanOrEqual" else x <= low
            if self.kind == "whole":
                ok &= x == F.floor(x)
        return F.coalesce(c.isNull() & F.lit(self.allow_blank) | ok, F.lit(False))


def valid_rows(df: DataFrame, column: str, lookup: DataFrame, lookup_column: str, *, allow_blank: bool = True, valid: bool = True) -> DataFrame:
    """Rows whose value is (or isn't) in the lookup: a semi or anti join, with blanks on the side that allow_blank says."""
    key = lookup.select(lookup[lookup_column].alias("__key")).where("__key is not null").distinct()
    joined = df.join(key, df[column] == F.col("__key"), "left_semi" if valid else "left_anti")
    if valid and allow_blank:
        return joined.unionByName(df.where(df[column].isNull()))
    return joined.where(F.col(column).isNotNull()) if not valid and allow_blank else joined


_OPERATORS = {
    "equal": lambda c, a, b: c == a,
    "notEqual": lambda c, a, b: c != a,
    "greaterThan": lambda c, a, b: c > a,
    "greaterThanOrEqual": lambda c, a, b: c >= a,
    "lessThan": lambda c, a, b: c < a,
    "lessThanOrEqual": lambda c, a, b: c <= a,
    "between": lambda c, a, b: c.between(a, b),
    "notBetween": lambda c, a, b: ~c.between(a, b),
}


def cell_is(column: str | Column, operator: str, value, other=None) -> Column:
    """Whether a cell meets a condition; values may be columns, in place of formulas."""
    if operator not in _OPERATORS:
        raise ValueError(f"no operator {operator!r}")
    if "etween" in operator and other is None:
        raise ValueError("between needs two values")
    return F.coalesce(_OPERATORS[operator](_c(column), value, other), F.lit(False))


SCALES = {"RedWhiteGreen": ("F8696B", "FFFFFF", "63BE7B"), "GreenWhiteRed": ("63BE7B", "FFFFFF", "F8696B"), "BlueWhiteRed": ("5A8AC6", "FFFFFF", "F8696B")}
BARS = {"Blue": "638EC6", "Green": "63C384", "Red": "FF555A"}


def _frame(df: DataFrame, column: str, by: Sequence[str], aggregates: list[Column]) -> DataFrame:
    """df with aggregates of the column: one row for each group, joined back, so that no single window holds the table."""
    if not by:
        return df.crossJoin(F.broadcast(df.agg(*aggregates)))  # one row
    stats = df.groupBy(*by).agg(*aggregates)
    on = [df[c].eqNullSafe(stats[c]) for c in by]
    return df.join(stats, on, "left").drop(*[stats[c] for c in by])


def color_scale(df: DataFrame, column: str, *, scale: str | tuple[str, str, str] = "RedWhiteGreen", by: Sequence[str] = (), position: str = "scale", color: str = "color", exact: bool = True) -> DataFrame:
    """df with each value's place between minimum (0), median (0.5) and maximum (1), and the color there.

    The exact median counts a group's distinct values in one task; exact=False has a sketch instead, for groups beyond a task's memory.
    """
    low, middle, high = SCALES[scale] if isinstance(scale, str) else scale
    x = _frame(df, column, by, [F.min(column).alias("__lo"), (F.percentile(column, F.lit(0.5)) if exact else F.percentile_approx(column, 0.5, 100_000)).alias("__mid"), F.max(column).alias("__hi")])
    v = F.col(column)
    below = F.when(F.col("__mid") > F.col("__lo"), (v - F.col("__lo")) / (F.col("__mid") - F.col("__lo")) / 2).otherwise(0.5)
    above = F.when(F.col("__hi") > F.col("__mid"), 0.5 + (v - F.col("__mid")) / (F.col("__hi") - F.col("__mid")) / 2).otherwise(0.5)
    x = x.withColumn(position, F.when(v <= F.col("__mid"), below).otherwise(above))
    p = F.col(position)

    def channel(k: int) -> Column:
        a, m, b = (int(s[2 * k : 2 * k + 2], 16) for s in (low, middle, high))
        value = F.when(p <= 0.5, a + (m - a) * p * 2).otherwise(m + (b - m) * (p * 2 - 1))
        return F.lpad(F.hex(F.round(value).cast("int")), 2, "0")

    return x.withColumn(color, F.concat(channel(0), channel(1), channel(2))).drop("__lo", "__mid", "__hi")


def data_bar(df: DataFrame, column: str, *, by: Sequence[str] = (), share: str = "bar") -> DataFrame:
    """df with each value's share of the way from the least to the greatest; 0 where all are equal."""
    x = _frame(df, column, by, [F.min(column).alias("__lo"), F.max(column).alias("__hi")])
    s = F.when(F.col("__hi") > F.col("__lo"), (F.col(column) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).when(F.col(column).isNotNull(), 0.0)
    return x.withColumn(share, s).drop("__lo", "__hi")


def running_total(df: DataFrame, amount: str, *, by: Sequence[str], order: Sequence[str], limit: float, total: str = "running", over: str = "over_limit") -> DataFrame:
    """df with the running total within each group, and whether it is over the limit."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(total, F.sum(amount).over(w)).withColumn(over, F.col(total) > limit)


def assert_within(df: DataFrame, amount: str, limit: float, message: str) -> DataFrame:
    """df, or an error as soon as a row is over the limit: caps reject, they don't cut off."""
    return df.where(F.coalesce(F.assert_true(df[amount] <= limit, message).isNull(), F.lit(True)))
