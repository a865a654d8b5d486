"""The sparse cell model: long (row, col, value) tables and wide ones, and dictionaries of strings and styles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, TimestampType

_BLOCK = 65_536


def to_cells(df: DataFrame, *, row: str, columns: Sequence[str] | None = None, keep_blank: bool = False) -> DataFrame:
    """(row, col, name, value) of a wide table, col from 1; blank cells only if asked for."""
    names = list(columns or [c for c in df.columns if c != row])
    each = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("col"), F.lit(n).alias("name"), df[n].cast("string").alias("value")) for i, n in enumerate(names)]))
    out = df.select(df[row].alias("row"), each.alias("x")).select("row", "x.*")
    return out if keep_blank else out.where("value is not null")


def to_rows(cells: DataFrame, width: int, *, names: Sequence[str] | None = None) -> DataFrame:
    """The wide table of cells (row, col, value), col from 1; the last column's aggregate is the greatest of repeated cells."""
    names = names or [f"Column{i}" for i in range(1, width + 1)]
    return cells.groupBy("row").agg(*[F.max(F.when(F.col("col") == i + 1, F.col("value"))).alias(n) for i, n in enumerate(names)])


def row_maps(cells: DataFrame) -> DataFrame:
    """(row, width, cells) with a map from col to value for each row."""
    return cells.groupBy("row").agg(F.max("col").alias("width"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("col", "value")))).alias("cells"))


def fill_rows(df: DataFrame, row: str, *, first: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """df with a row for each missing number from `first` to the last one."""
    last = df.groupBy(*by).agg(F.max(row).cast("long").alias("__last")).where(F.col("__last") >= first)
    # the numbers of a group are made by many tasks, some ten thousands by each
    blocks = last.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__last - {int(first)}) div {_BLOCK}"))).alias("__block")).repartition(*by, "__block")
    begin = F.lit(first).cast("long") + F.col("__block") * _BLOCK
    all_ = blocks.select(*by, F.explode(F.sequence(begin, F.least(begin + _BLOCK - 1, "__last"))).alias(row))
    return all_.join(df.withColumn(row, df[row].cast("long")), [*by, row], "left")


def edit(cells: DataFrame, changes: DataFrame) -> DataFrame:
    """cells (row, col, value, formula) with changes of the same shape: a change's value or formula replaces both, a blank one removes the cell."""
    c, d = cells.alias("c"), changes.select("row", "col", F.col("value").alias("new_value"), F.col("formula").alias("new_formula"), F.lit(True).alias("changed"))
    x = c.join(d, ["row", "col"], "full")
    pick = lambda old, new: F.when(F.col("changed"), F.col(new)).otherwise(F.col(old))
    out = x.select("row", "col", F.when(F.col("new_formula").isNull() | F.col("changed").isNull(), pick("value", "new_value")).alias("value"), pick("formula", "new_formula").alias("formula"))
    return out.where("value is not null or formula is not null")


def number_rows(df: DataFrame, given: str, order: str, *, by: Sequence[str] = (), out: str = "row") -> DataFrame:
    """Row numbers where a row without one follows the one before by one.

    A group of `by` is one task; without `by`, rows are numbered within buckets of the range of `order`, and each bucket begins
    where the one before ends, if `order` is a number or a time; other types are sorted in one task.
    """
    if by or not isinstance(df.schema[order].dataType, (NumericType, TimestampType)):
        x, keys = df, list(by)
    else:
        x, keys = _buckets(df, order, 1024), ["__b"]
    w = Window.partitionBy(*keys).orderBy(order)
    x = x.withColumn("__block", F.count(F.when(F.col(given).isNotNull(), 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(*keys, "__block").orderBy(order)
    start = F.first(given).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("__n", F.row_number().over(inner)).withColumn("__start", F.when(F.col("__block") > 0, start))
    if keys != ["__b"]:
        return x.withColumn(out, F.coalesce(F.col("__start") - 1, F.lit(0)) + F.col("__n")).drop("__block", "__n", "__start")
    # what each bucket's last row has, if a number is given in it
    last = F.max(F.struct("__block", "__n", (F.col("__start") - 1 + F.col("__n")).alias("end")))["end"]
    ends = x.groupBy("__b").agg(F.count(F.lit(1)).alias("__rows"), last.alias("__end"))
    through = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__sum", F.sum("__rows").over(through))  # a row for each bucket
    before = F.coalesce(F.last(F.col("__end") - F.col("__sum"), ignorenulls=True).over(earlier), F.lit(0)) + F.col("__sum") - F.col("__rows")
    x = x.join(F.broadcast(ends.select("__b", before.alias("__before"))), "__b")
    return x.withColumn(out, F.coalesce(F.col("__start") - 1, F.col("__before")) + F.col("__n")).drop("__b", "__block", "__n", "__start", "__before")


def _buckets(df: DataFrame, order: str, buckets: int) -> DataFrame:
    """df with __b: the bucket, of equal parts of the range of a numeric column; -1 for a null."""
    ends = df.agg(F.min(order).cast("double").alias("__lo"), F.max(order).cast("double").alias("__hi"))
    place = (F.col(order).cast("double") - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1) * buckets
    x = df.crossJoin(F.broadcast(ends))  # one row
    return x.withColumn("__b", F.when(place.isNull(), -1).otherwise(F.least(F.floor(place), F.lit(buckets - 1)).cast("int"))).drop("__lo", "__hi")


def dense_ids(df: DataFrame, order: str, *ties: str, out: str, buckets: int = 1024) -> DataFrame:
    """df with ranks from 0 by a numeric column: rows are ranked within buckets of its range, and the buckets' sizes summed up, so no task sees all rows."""
    x = _buckets(df, order, buckets)
    sizes = x.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__b", before.alias("__before"))  # a row for each bucket
    rank = F.row_number().over(Window.partitionBy("__b").orderBy(order, *ties)) - 1
    return x.join(F.broadcast(offsets), "__b").withColumn(out, (F.col("__before") + rank).cast("long")).drop("__b", "__before")


def intern_strings(df: DataFrame, text: str, position: str | Column) -> DataFrame:
    """(text, id): distinct strings, numbered from 0 by first use; the position is a number."""
    first = df.where(df[text].isNotNull()).groupBy(df[text].alias("text")).agg(F.min(position).alias("first"))
    return dense_ids(first, "first", "text", out="id").select("text", "id")


def string_counts(df: DataFrame, text: str, by: Sequence[str] = ()) -> DataFrame:
    """(total, distinct) uses of strings."""
    return df.groupBy(*by).agg(F.count(text).alias("total_refs"), F.countDistinct(text).alias("unique_refs"))


def resolve_strings(cells: DataFrame, strings: DataFrame) -> DataFrame:
    """cells (.., id, raw) with text: the string of the id, or the raw value where there is none."""
    return cells.join(strings.select(F.col("id").alias("__id"), F.col("text").alias("__text")), F.col("id") == F.col("__id"), "left").withColumn("text", F.coalesce("__text", "raw")).drop("__id", "__text")


def intern_styles(df: DataFrame, style: Sequence[str], position: str) -> DataFrame:
    """df with style_id: equal combinations share a number, given by first use from 0."""
    key = F.struct(*style)
    ids = df.groupBy(F.to_json(key).alias("__k")).agg(F.min(position).alias("__first"))
    ids = dense_ids(ids, "__first", "__k", out="style_id").select("__k", "style_id")
    return df.withColumn("__k", F.to_json(key)).join(ids, "__k", "left").drop("__k")


def suffix_collisions(df: DataFrame, name: str, order: str, *, by: Sequence[str] = (), out: str = "file_name") -> DataFrame:
    """Names made unique: the second a.png is a_1.png, the third a_2.png."""
    n = F.row_number().over(Window.partitionBy(*by, F.lower(name)).orderBy(order)) - 1
    stem = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1)
    dot = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return df.withColumn(out, F.when(n == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), dot)))


def carry_forward(df: DataFrame, column: str, order: str, *, by: Sequence[str], out: str) -> DataFrame:
    """The last value so far that isn't null."""
    return df.withColumn(out, F.last(column, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def concat_text(df: DataFrame, text: str, order: str, *, by: Sequence[str], separator: str = "\n", out: str = "text") -> DataFrame:
    """One text for each group: its parts in order."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(parts, lambda x: x["t"]), separator).alias(out))


def explode_grid(df: DataFrame, grid: str, *keep: str) -> DataFrame:
    """(.., row, col, value) of an array of arrays, both from 0."""
    rows = df.select(*keep, F.posexplode(grid).alias("row", "__cells"))
    return rows.select(*keep, "row", F.posexplode("__cells").alias("col", "value"))


def pad_row(cells: str | Column, width: int) -> Column:
    """An array made exactly `width` long, missing cells as ''."""
    c = F.col(cells) if isinstance(cells, str) else cells
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.coalesce(F.try_element_at(c, i), F.lit("")))


def widest(grid: str | Column) -> Column:
    """The number of cells in the longest row of a grid."""
    g = F.col(grid) if isinstance(grid, str) else grid
    return F.coalesce(F.array_max(F.transform(g, F.size)), F.lit(0))
