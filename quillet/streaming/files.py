"""Workbooks that arrive in a folder, as a stream of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.xlsx import read_binary

__all__ = ["stream_cells"]


def stream_cells(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The cells of each workbook that comes into a folder, once; options as of format("xlsx")."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.xlsx").load(folder)
    return read_binary(files, **options)
