"""Zip archives: listing and contents as DataFrames, safe extraction and writing."""

from __future__ import annotations

import datetime as dt
import os
import re
import shutil
import time
import uuid
import zipfile
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .package import LimitError, read_capped

ENTRIES = "archive string, name string, size long, compressed_size long, modified timestamp_ntz, is_dir boolean"


@dataclass(frozen=True)
class Limits:
    """What extraction accepts; beyond it, it fails, and leaves what it extracted so far."""

    max_entries: int = 100_000
    max_entry_bytes: int = 1 << 30
    max_total_bytes: int = 10 << 30


def check_name(name: str) -> str:
    """The name with forward slashes, or an error if it is empty, absolute, names a drive or climbs."""
    n = name.replace("\\", "/")
    if not n.strip() or n.startswith("/") or re.match("[A-Za-z]:", n) or ".." in n.split("/"):
        raise ValueError(f"not a safe entry name: {name!r}")
    return n


def target_of(folder: str, name: str) -> str:
    """Where an entry goes, or an error if that is outside the folder."""
    root = os.path.realpath(folder)
    path = os.path.realpath(os.path.join(root, check_name(name)))
    if path != root and not path.startswith(root + os.sep):
        raise ValueError(f"{name!r} would leave the folder")
    return path


def entries(path: str) -> list[zipfile.ZipInfo]:
    with zipfile.ZipFile(path) as z:
        return z.infolist()


def find_entry(path: str, name: str) -> zipfile.ZipInfo | None:
    """The entry of exactly this name."""
    return next((e for e in entries(path) if e.filename == name), None)


def extract(path: str, folder: str, limits: Limits | None = None) -> list[str]:
    """Extracts an archive; returns the files' paths."""
    limits, out, total = limits or Limits(), [], 0
    with zipfile.ZipFile(path) as z:
        if len(z.infolist()) > limits.max_entries:
            raise LimitError(f"the archive has more than {limits.max_entries} entries")
        for e in z.infolist():
            to = target_of(folder, e.filename)
            if e.is_dir():
                os.makedirs(to, exist_ok=True)
                continue
            os.makedirs(os.path.dirname(to), exist_ok=True)
            size = 0
            with z.open(e) as f, open(to, "wb") as g:
                while block := f.read(1 << 16):
                    size += len(block)
                    if size > limits.max_entry_bytes:
                        raise LimitError(f"{e.filename} has more than {limits.max_entry_bytes} bytes")
                    if total + size > limits.max_total_bytes:
                        raise LimitError(f"the archive has more than {limits.max_total_bytes} bytes")
                    g.write(block)
            total += size
            when = time.mktime(dt.datetime(*e.date_time).timetuple()) if e.date_time[1] else time.time()
            os.utime(to, (when, when))
            out.append(to)
    return out


class ArchiveWriter:
    """Writes an archive under a temporary name until it is closed without an error."""

    def __init__(self, path: str):
        self.path, self.temp = path, f"{path}.{uuid.uuid4().hex}"
        self.zip = zipfile.ZipFile(self.temp, "w", zipfile.ZIP_DEFLATED)

    def __enter__(self) -> ArchiveWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        self.zip.close()
        if kind is None:
            os.replace(self.temp, self.path)
        else:
            os.remove(self.temp)

    def add_bytes(self, name: str, data: bytes) -> None:
        self.zip.writestr(check_name(name), data)

    def add_text(self, name: str, text: str) -> None:
        self.add_bytes(name, text.encode())

    def add_stream(self, name: str, stream) -> None:
        with self.zip.open(check_name(name), "w", force_zip64=True) as f:
            shutil.copyfileobj(stream, f)

    def add_file(self, path: str, name: str | None = None) -> None:
        self.zip.write(path, check_name(name or os.path.basename(path)))


def zip_folder(folder: str, path: str) -> int:
    """All files below a folder, by their names relative to it; returns their number."""
    n = 0
    with ArchiveWriter(path) as w:
        for d, dirs, files in os.walk(folder):
            dirs.sort()
            for f in sorted(files):
                full = os.path.join(d, f)
                if os.path.abspath(full) not in (os.path.abspath(path), os.path.abspath(w.temp)):
                    w.add_file(full, os.path.relpath(full, folder).replace(os.sep, "/"))
                    n += 1
    return n


def zip_files(files: Iterable[str], path: str) -> None:
    """Files by their base names."""
    with ArchiveWriter(path) as w:
        for f in files:
            w.add_file(f)


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.contents = self.options.get("content", "false").lower() == "true"

    def partitions(self):
        import glob

        path = self.options["path"].removeprefix("file://")
        files = sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.lower().endswith(".zip")) if os.path.isdir(path) else sorted(glob.glob(path)) or [path]
        return [_Archive(p) for p in files]

    def read(self, partition: _Archive):
        limits = Limits(*(int(self.options.get(k, d)) for k, d in (("maxentries", 100_000), ("maxentrybytes", 1 << 30), ("maxtotalbytes", 10 << 30))))
        total = 0
        with zipfile.ZipFile(partition.path) as z:
            if len(z.infolist()) > limits.max_entries:
                raise LimitError(f"the archive has more than {limits.max_entries} entries")
            for e in z.infolist():
                when = dt.datetime(*e.date_time) if e.date_time[1] and e.date_time[2] else None
                row = (partition.path, e.filename, e.file_size, e.compress_size, when, e.is_dir())
                if not self.contents:
                    yield row
                    continue
                body = None
                if not e.is_dir():
                    with z.open(e) as f:
                        body = read_capped(f, limits.max_entry_bytes, e.filename)
                    total += len(body)
                    if total > limits.max_total_bytes:
                        raise LimitError(f"the archive has more than {limits.max_total_bytes} bytes")
                yield (*row, body)


class ZipDataSource(DataSource):
    """format("zip"): the entries of archives, one partition for each archive; option content adds their bytes."""

    @classmethod
    def name(cls) -> str:
        return "zip"

    def schema(self) -> str:
        content = {k.lower(): v for k, v in self.options.items()}.get("content", "false").lower() == "true"
        return ENTRIES + (", content binary" if content else "")

    def reader(self, schema) -> ZipReader:
        return ZipReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipDataSource)


def list_entries(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("zip").load(path)
