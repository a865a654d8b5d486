"""Repeated passages by sparse suffix arrays.

Of each document's suffixes (by words) only those at minimisers are kept: places where the hash of the next
`K` words is the least of `WINDOW` in a row.  The content alone selects them, so a passage of
`K + WINDOW - 1` = 50 words has the same one in each document that holds it.  A suffix carries the
hashes of the 50-word windows whose minimiser it is, so a window is in one suffix of each document.  Suffixes are
sorted by the hash of their K words; where several documents have one, windows are sorted, and
neighbours with equal windows, of different documents, are paired.  However many documents share
a line, and wherever they go on differently, documents with a common window are thus chained.  Windows that
follow each other along one diagonal of two documents are a run, which is extended word by word to the left and right.

Extension needs no whole texts.  A run ends where the documents differ, or where one of them has another neighbour.
A second map over the documents emits the one word on each side of each end (the wanted places come
from a memory-mapped digest array); the few runs whose documents agree there are looked at again, farther.
Words are compared by 64 bits, windows by the 64 bits of their K words and 32 bits of all of theirs.

Scale: the suffixes, about one row of 75 bytes for 13 words, are written and range-partitioned by hash and document, so
that a line in all documents is many tasks.  A group of equal hashes that a partition's border or a block of `GROUP` suffixes
cuts passes the first and last document of each of its windows on to a second, small shuffle, which
joins the pieces.  Pairs of neighbours are linear in the suffixes: a passage in m documents yields m - 1 pairs, not m * m.
The text itself is never shuffled, and nothing is broadcast.

Defined results: null and empty texts, null ids and texts of fewer than `min_words` words match
nothing; a row that repeats id and text is the same document; two texts under one id are two documents
with that id, and may match; all repeats within a document are looked at, and one of equal windows meets
the next document's.  Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DigestArray, discard, need, signed, written
from .textops import Words, chunks, flat, grams, lists, mix, sliding_min, within

MIN_WORDS = 50
K = 25
#: Suffixes that are compared in memory at once.
GROUP = 1 << 13

_SUFFIX = "h long, windows array<int>, doc long, start int"
_FOUND = "g long, a long, b long, shift int, start int, stop int"
#: What a document's window is to its piece of a cut group.
_FIRST, _LAST = 1, 2


def suffixes(buf: np.ndarray, off: np.ndarray, k: int, window: int):
    """(hash, hashes of windows, their number, document, the first window's place in words) of the kept suffixes of a chunk."""
    w = Words(buf, off)
    h = grams(w.hash, k)
    # short documents may have fewer runs than a window: they can't hold a passage of k + window - 1 words
    i = np.flatnonzero(within(w.owner, k + window - 1))
    if not len(i):
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), empty, empty, empty
    windows = (grams(w.hash, k + window - 1)[i] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    least = sliding_min(h, window)[i]
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    owner = w.owner[i[first]]
    return h[least[first]], windows, np.diff(np.append(first, len(i))), owner, i[first] - w.first[owner]


def _documents(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = need(documents, id_col, text_col).toDF("id", "text").where("id is not null and text is not null")
    return docs.withColumn("doc", F.xxhash64("id", "text"))


def suffix_table(docs: DataFrame, k: int, window: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            buf, off = flat(batch["text"])
            doc = batch["doc"].to_numpy(zero_copy_only=False)
            for a, b in chunks(off):
                h, windows, sizes, owner, start = suffixes(buf[off[a] : off[b]], off[a : b + 1] - off[a], k, window)
                if len(h):
                    yield pa.RecordBatch.from_arrays([signed(h), lists(pa.array(windows), sizes), pa.array(doc[owner + a]), pa.array(start, pa.int32())], ["h", "windows", "doc", "start"])

    return docs.select("doc", "text").mapInArrow(run, _SUFFIX)


def _windows(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, document, place) of each window of the suffixes, in this order."""
    windows = t["windows"].combine_chunks()
    size = windows.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(t)), size)
    h = t["h"].to_numpy().view(np.uint64)
    key = mix(h[row] + windows.flatten().to_numpy().view(np.uint32) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    doc = t["doc"].to_numpy()[row]
    at = t["start"].to_numpy().astype(np.int64)[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    order = np.lexsort((at, doc, key))
    return key[order], doc[order], at[order]


def _neighbours(i: np.ndarray, doc: np.ndarray, at: np.ndarray, length: int) -> pa.RecordBatch:
    """(a, b, shift, start, stop) of the windows i and i + 1: those that follow each other on a diagonal are one row."""
    swap = doc[i] > doc[i + 1]
    a, b = np.where(swap, i + 1, i), np.where(swap, i, i + 1)
    c = np.stack([doc[a], doc[b], at[b] - at[a], at[a]], 1)
    c = c[np.lexsort(c.T[::-1])]
    lead = np.ones(len(c), bool)
    lead[1:] = (c[1:, :3] != c[:-1, :3]).any(1) | (c[1:, 3] > c[:-1, 3] + 1)
    first = np.flatnonzero(lead)
    last = np.append(first[1:], len(c)) - 1
    return pa.RecordBatch.from_arrays(
        [pa.nulls(len(first), pa.int64()), pa.array(c[first, 0]), pa.array(c[first, 1]), pa.array(c[first, 2], pa.int32()), pa.array(c[first, 3], pa.int32()), pa.array(c[last, 3] + length, pa.int32())], ["g", "a", "b", "shift", "start", "stop"]
    )


def neighbour_pairs(rows: DataFrame, length: int, *, group: int = GROUP) -> DataFrame:
    """(a, b, shift, start, stop) of neighbours, in the order of documents, among those with a common window.

    start and stop bound the windows of `length` words in a; shift is b's place minus a's.
    """

    def ends(key, doc, at):
        """The first and the last row of each window."""
        role = np.zeros(len(key), np.int64)
        role[np.append(True, key[1:] != key[:-1])] |= _FIRST
        role[np.append(key[1:] != key[:-1], True)] |= _LAST
        i = np.flatnonzero(role)
        return pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(doc[i]), pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.int32()), pa.array(at[i], pa.int32()), pa.array(role[i], pa.int32())], ["g", "a", "b", "shift", "start", "stop"])

    def block(t, cut):
        """Neighbours among the suffixes; `cut` are the hashes of which there may be more elsewhere."""
        h, doc = t["h"].to_numpy(), t["doc"].to_numpy()
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(first, len(h)))
        open_ = np.isin(h[first], cut)
        several = doc[first] != doc[first + size - 1]  # sorted by document
        key, at_doc, at = _windows(t.take(pa.array(np.flatnonzero(np.repeat(several, size)))))
        i = np.flatnonzero((key[1:] == key[:-1]) & (at_doc[1:] != at_doc[:-1]))
        if len(i):
            yield _neighbours(i, at_doc, at, length)
        if open_.any():
            yield ends(*_windows(t.take(pa.array(np.flatnonzero(np.repeat(open_, size))))))

    def compare(batches):
        held, n, cut = [], 0, None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not len(t):
                continue
            if cut is None:
                cut = [t["h"][0].as_py()]  # the partition before may end with it
            held, n = [*held, t], n + len(t)
            if n < group:
                continue
            t = pa.concat_tables(held)
            h = t["h"].to_numpy()
            last = int(np.searchsorted(h, h[-1])) or n
            if last == n:  # a single hash, of which more may come
                cut.append(int(h[-1]))
            yield from block(t.slice(0, last), cut)
            cut = cut[-1:] if last == n else []
            held, n = [t.slice(last)] if last < n else [], n - last
        if n:
            t = pa.concat_tables(held)
            yield from block(t, [*cut, t["h"][-1].as_py()])

    def join(batches):
        last = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            key, doc, at, role = (np.concatenate([x, batch[c].to_numpy(zero_copy_only=False).astype(np.int64)]) for x, c in zip(last, ("g", "a", "start", "stop")))
            last = [x[-1:] for x in (key, doc, at, role)]
            i = np.flatnonzero((key[1:] == key[:-1]) & (doc[1:] != doc[:-1]) & (role[:-1] & _LAST > 0) & (role[1:] & _FIRST > 0))
            if len(i):
                yield _neighbours(i, doc, at, length)

    found = written(rows.repartitionByRange("h", "doc").sortWithinPartitions("h", "doc", "start").mapInArrow(compare, _FOUND), "neighbours")
    pieces = found.where("g is not null").repartition("g").sortWithinPartitions("g", "a", "start")
    return found.where("g is null").unionByName(pieces.mapInArrow(join, _FOUND)).drop("g")


def runs_of(pairs: DataFrame) -> DataFrame:
    """(run, a, b, shift, start, stop): stretches along each diagonal, joined where they meet."""

    def join(batches):
        carry = None
        for batch in batches:
            c = np.stack([batch[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in ("a", "b", "shift", "start", "stop")], 1)
            if carry is not None:
                c = np.concatenate([carry, c])
            if not len(c):
                continue
            last = np.flatnonzero((c[:, :3] == c[-1, :3]).all(1))[0]
            carry = c[last:]
            if last:
                yield fold_(c[:last])
        if carry is not None:
            yield fold_(carry)

    def fold_(c):
        other = np.append(True, (c[1:, :3] != c[:-1, :3]).any(1))
        # the farthest stop so far on each diagonal
        line = np.cumsum(other) << 32
        reach = np.maximum.accumulate(line + c[:, 4])
        lead = other.copy()
        lead[1:] |= line[1:] + c[1:, 3] > reach[:-1]
        first = np.flatnonzero(lead)
        stop = np.maximum.reduceat(c[:, 4], first)
        return pa.RecordBatch.from_arrays([*(pa.array(c[first, n]) for n in range(2)), *(pa.array(c[first, n], pa.int32()) for n in (2, 3)), pa.array(stop, pa.int32())], ["a", "b", "shift", "start", "stop"])

    rows = pairs.select("a", "b", "shift", "start", "stop").repartition("a", "b").sortWithinPartitions("a", "b", "shift", "start")
    return rows.mapInArrow(join, "a long, b long, shift int, start int, stop int")


def _edges(docs: DataFrame, wanted: DigestArray, reach: int) -> DataFrame:
    """(run, side, words): hashes of up to `reach` words before (sides 0, 1) or from (2, 3) each wanted place, the nearest first."""

    def run(batches):
        for batch in batches:
            keys = batch["doc"].to_numpy(zero_copy_only=False).view(np.uint64)
            which, where = wanted.find(keys)
            if not len(which):
                continue
            asked = dict(zip(which.tolist(), wanted.values(where).to_pylist()))
            some = sorted(asked)
            buf, off = flat(batch["text"].take(pa.array(some)))
            for a, b in chunks(off):
                w = Words(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                items = [np.array([x.split(":") for x in asked[some[d]].split(",")], np.int64) for d in range(a, b)]
                owner = np.repeat(np.arange(b - a), [len(x) for x in items])
                ids, side, at = np.concatenate(items).T
                place = w.first[owner] + at
                back = side < 2
                size = np.minimum(np.where(back, at, w.first[owner + 1] - place), reach)
                row = np.repeat(np.arange(len(size)), size)
                local = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                words = w.hash[np.where(back[row], place[row] - 1 - local, place[row] + local)]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(side, pa.int32()), lists(signed(words), size)], ["run", "side", "words"])

    return docs.select("doc", "text").mapInArrow(run, "run long, side int, words array<long>")


def _common(x: pa.Array, y: pa.Array) -> pa.Array:
    """Lengths of the common beginnings of two columns of lists; a null is an empty one."""
    sizes = [c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (x, y)]
    values = [c.flatten().to_numpy(zero_copy_only=False) for c in (x, y)]
    n = np.minimum(*sizes)
    row = np.repeat(np.arange(len(n)), n)
    local = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    p, q = (v[(np.cumsum(s) - s)[row] + local] for v, s in zip(values, sizes))
    differ = np.flatnonzero(p != q)
    np.minimum.at(n, row[differ], local[differ])
    return pa.array(n)


def _extended(docs: DataFrame, runs: DataFrame, reach: int = 1) -> DataFrame:
    """(a, b, shift, start, stop) of runs extended as far as the documents agree.

    Nearly all runs end where the documents differ, so one word is looked at first; the others, whose
    documents have other neighbours there, are looked at again, ever farther, until none is left.
    """
    common = F.arrow_udf(_common, "long")
    done = None
    while True:
        side = F.explode(F.array(*[F.struct(F.lit(n).alias("side"), d.alias("doc"), p.alias("at")) for n, d, p in ((0, F.col("a"), F.col("start")), (1, F.col("b"), F.col("start") + F.col("shift")), (2, F.col("a"), F.col("stop")), (3, F.col("b"), F.col("stop") + F.col("shift")))]))
        asked = runs.select("run", side.alias("s")).select("s.doc", F.concat_ws(":", "run", "s.side", "s.at").alias("v"))
        wanted = DigestArray.store(asked.groupBy("doc").agg(F.array_join(F.sort_array(F.collect_list("v")), ",").alias("v")), "doc", "v", "places", per_file=1 << 16)
        piece = [F.first(F.when(F.col("side") == n, F.col("words")), ignorenulls=True).alias(f"w{n}") for n in range(4)]
        ends = _edges(docs, wanted, reach).groupBy("run").agg(*piece).select("run", common("w0", "w1").alias("left"), common("w2", "w3").alias("right"))
        found = written(runs.join(ends, "run"), "extended")
        stopped = found.where((F.col("left") < reach) & (F.col("right") < reach)).select("a", "b", "shift", (F.col("start") - F.col("left")).alias("start"), (F.col("stop") + F.col("right")).alias("stop"))
        done = stopped if done is None else done.unionByName(stopped)
        runs = found.where((F.col("left") >= reach) | (F.col("right") >= reach)).drop("left", "right")
        if runs.isEmpty():
            return done
        reach = 64 if reach < 64 else 16 * reach


def repeated_passages(documents: DataFrame, *, min_words: int = MIN_WORDS, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_a, doc_b, start_a, start_b, n_words) of the maximal passages of at least `min_words` words that neighbours share.

    Starts count words from 0.  Documents that hold a passage are chained: m of them give m - 1 rows at least.
    """
    if not 0 < k <= min_words:
        raise ValueError("k must be from 1 to min_words")
    docs = _documents(documents, id_col, text_col)
    table = written(suffix_table(docs, k, min_words - k + 1), "suffixes")
    runs = written(runs_of(neighbour_pairs(table, min_words)).withColumn("run", F.monotonically_increasing_id()), "runs")
    discard(table)
    # runs that met in extending are one
    found = runs_of(_extended(docs, runs))
    names = docs.select("doc", "id").distinct()
    out = found.join(names.toDF("a", "id_a"), "a").join(names.toDF("b", "id_b"), "b")
    swap = F.col("id_a") > F.col("id_b")
    at_b = F.col("start") + F.col("shift")
    return out.select(
        F.when(swap, F.col("id_b")).otherwise(F.col("id_a")).alias("doc_a"),
        F.when(swap, F.col("id_a")).otherwise(F.col("id_b")).alias("doc_b"),
        F.when(swap, at_b).otherwise(F.col("start")).alias("start_a"),
        F.when(swap, F.col("start")).otherwise(at_b).alias("start_b"),
        (F.col("stop") - F.col("start")).alias("n_words"),
    ).distinct()


def by_document(passages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_words, other_id, other_start): a row for each side of repeated_passages()."""
    side = lambda x, y: F.struct(F.col(f"doc_{x}").alias(id_col), F.col(f"start_{x}").alias("start"), "n_words", F.col(f"doc_{y}").alias("other_id"), F.col(f"start_{y}").alias("other_start"))
    return passages.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("s")).select("s.*")
