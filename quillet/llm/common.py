"""What the corpus operators share: the shared folder, written tables and digest arrays."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_used: dict[str, list[str]] = {}
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, as in tests on one machine, one of our own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="quillet-")
    return _own[app]


def fresh_path(spark: SparkSession, tag: str, *, keep: bool = False) -> str:
    """A new path in the shared folder; the scope it is taken in, or else release(), deletes what is there unless it is to be kept."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if not keep:
        inner = _scope.get()
        (_used.setdefault(spark.sparkContext.applicationId, []) if inner is None else inner).append(path)
    return path


def delete(spark: SparkSession, *paths: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables and arrays that operators left since its beginning, and no others: write their results inside."""
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        delete(spark, *paths)


def release(spark: SparkSession) -> int:
    """Deletes the tables and arrays that this session's operators left in the shared folder outside of scopes; returns their number.

    Results are lazy and read them: write all results first, or take a scope for each.
    """
    paths = _used.pop(spark.sparkContext.applicationId, [])
    delete(spark, *paths)
    return len(paths)


def local_path(uri: str) -> str:
    """The mounted path of a file: URI; memory maps need one."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped arrays need a mounted shared folder, not {parts.scheme}:")
    return parts.path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder, read back: its lineage ends there, so a lost executor costs one read."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    delete(table.sparkSession, table._written_to)


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns: other columns, whatever their names, can't clash with an operator's own."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no column {missing[0]!r} among {df.columns}")
    return df.select(*[df[c] for c in columns])


class DigestArray:
    """Sorted 64-bit keys, each with a row of values, in files that readers memory-map.

    `store` runs in Spark: rows are range-split by the top bits of the key, each
    split is sorted by one task and saved under a name that depends on the split
    alone, and put in place by a rename, so a task that runs twice leaves one file.
    """

    def __init__(self, path: str, bits: int):
        self.path, self.bits = path, bits
        self._maps: dict[int, tuple] = {}

    def __getstate__(self):
        return {"path": self.path, "bits": self.bits, "_maps": {}}

    @classmethod
    def store(cls, df: DataFrame, key: str, value: str | None, tag: str, per_file: int = 1 << 20, rows: int | None = None) -> DigestArray:
        """df's bigint `key` (read as unsigned), with `value` (a bigint, or else as a string) if there is one.  Nulls in key are dropped.

        Equal rows are stored once; df isn't looked through for them if the number of its rows is given, all of which differ.
        """
        from pyspark.sql import functions as F

        numeric = value is not None and df.schema[value].dataType.simpleString() == "bigint"

        spark = df.sparkSession
        uri = fresh_path(spark, tag)
        folder = local_path(uri)
        os.makedirs(folder, exist_ok=True)
        cols = [F.col(key).cast("long").alias("k"), (F.col(value) if value else F.lit(None)).cast("bigint" if numeric else "string").alias("v")]
        table = df.select(*cols).where("k is not null")
        table = table if rows is not None else written(table.distinct(), tag)
        bits = max(0, int(np.ceil(np.log2(max(1, table.count() if rows is None else rows) / per_file))))
        shard = F.shiftrightunsigned("k", 64 - bits).cast("int") if bits else F.lit(0)

        def save(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            n = keys[0].as_py()
            k = table["k"].combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64)
            v = table["v"].combine_chunks()
            order = np.argsort(k, kind="stable")
            k = k[order]
            temp = f"{folder}/.{n}-{uuid.uuid4().hex}"
            if numeric:
                np.save(temp + ".npy", v.to_numpy(zero_copy_only=False)[order])
                os.replace(temp + ".npy", f"{folder}/{n}.v.npy")
            elif value:
                table = pa.table({"v": v.take(pa.array(order)).cast(pa.large_string())})
                with pa.OSFile(temp, "wb") as f, pa.ipc.new_file(f, table.schema) as w:
                    w.write_table(table.combine_chunks())
                os.replace(temp, f"{folder}/{n}.arrow")
            np.save(temp + ".npy", k)
            os.replace(temp + ".npy", f"{folder}/{n}.npy")
            return pa.table({"shard": pa.array([n], pa.int32()), "n": pa.array([len(k)], pa.int64())})

        table.withColumn("shard", shard).groupBy("shard").applyInArrow(save, "shard int, n long").write.format("noop").mode("overwrite").save()
        return cls(folder, bits)

    def _open(self, n: int) -> tuple:
        if n not in self._maps:
            at = f"{self.path}/{n}.npy"
            if not os.path.exists(at):
                self._maps[n] = (np.zeros(0, np.uint64), None)
            else:
                values = f"{self.path}/{n}.arrow"
                strings = np.load(f"{self.path}/{n}.v.npy", mmap_mode="r") if os.path.exists(f"{self.path}/{n}.v.npy") else None
                if os.path.exists(values):
                    strings = pa.ipc.open_file(pa.memory_map(values)).read_all()["v"].combine_chunks()
                self._maps[n] = (np.load(at, mmap_mode="r"), strings)
        return self._maps[n]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into keys, position) of every stored row whose key is among the keys; position is by file in the low 32 bits."""
        keys = np.ascontiguousarray(keys, np.uint64)
        shards = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        which, where = [], []
        for n in np.unique(shards):
            stored = self._open(int(n))[0]
            at = np.flatnonzero(shards == n)
            lo, hi = np.searchsorted(stored, keys[at], "left"), np.searchsorted(stored, keys[at], "right")
            count = hi - lo
            hit = np.flatnonzero(count)
            c = count[hit]
            which.append(np.repeat(at[hit], c))
            where.append(np.repeat(lo[hit], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + (int(n) << 32))
        if not which:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(which), np.concatenate(where).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        out[self.find(keys)[0]] = True
        return out

    def values(self, where: np.ndarray) -> pa.Array:
        """The stored strings at positions of find()."""
        out = [""] * len(where)
        shards = where >> 32
        for n in np.unique(shards):
            strings = self._open(int(n))[1]
            at = np.flatnonzero(shards == n)
            for i, s in zip(at.tolist(), strings.take(pa.array(where[at] & 0xFFFFFFFF)).to_pylist()):
                out[i] = s
        return pa.array(out, pa.large_string())

    def numbers(self, where: np.ndarray) -> np.ndarray:
        """The stored numbers at positions of find()."""
        out = np.zeros(len(where), np.int64)
        shards = where >> 32
        for n in np.unique(shards):
            at = np.flatnonzero(shards == n)
            out[at] = self._open(int(n))[1][where[at] & 0xFFFFFFFF]
        return out


def signed(h: np.ndarray) -> pa.Array:
    """uint64 hashes as a bigint column."""
    return pa.array(np.ascontiguousarray(h).view(np.int64))


__all__ = ["DigestArray", "delete", "discard", "fresh_path", "local_path", "need", "release", "scope", "shared_dir", "signed", "written"]
