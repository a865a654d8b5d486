"""SimHash near-duplicates found through sharded BK-trees.

A document's fingerprint has 128 bits: each bit is the majority, over the distinct
words of the document, of one bit of the words' hashes.  Two documents are near
copies if their fingerprints differ in at most `radius` bits.

Candidates: fingerprints are sharded by `tables` keys of `key_bits` bits taken from
disjoint places of a few fixed permutations.  Each shard's fingerprints form a
BK-tree (children keyed by their integer distance to the parent), every fingerprint
of the shard is a query, and a query at distance d from a node follows only the
edges d - radius .. d + radius, so within a shard the search is exact.  A pair is
missed only if it differs under every key: `tables` is chosen so that a pair at
the radius itself, and so any nearer one, is met with probability `recall` at least, at every size of the corpus.

Scale: the trees are not broadcast, since they grow with the corpus: each shard's
tree is built where the shuffle puts the shard's rows, and queried there by those
same rows.  Rows with equal fingerprints are one node, so a text with a million
copies costs one node and no pairs of copies.  Beyond 2**24 distinct fingerprints
the keys widen with the corpus, which holds shards to about 256 rows on average.
All shards of a task are built and searched together, level by level, in NumPy.
A dense group of n fingerprints has n * n / 2 near pairs in each shard; groups need
only what joins it, so a task keeps a spanning forest of its pairs, fewer than it has
rows, and no query looks below nodes that are all of its own component already.

Groups are the connected components of near copies (large-star / small-star, each
round a written table); the document with the least id stays.

Defined results: a row with a null id, a null text or a text without a word takes no
part (it is in no group and is kept); equal texts are always in one group; rows that
repeat an id with one fingerprint are one document, kept once, with the least text; texts of other fingerprints under that id are other documents,
each in its own group: what goes is told by id and fingerprint.  Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import DigestArray, need, signed, written
from .textops import Words, chunks, flat, mix

BITS = 128
RADIUS = 20
RECALL = 0.9
#: Rows of all shards that one task makes, about.
SPREAD_ROWS = 1 << 20

_LANES = np.array([sum(((b >> (7 - j)) & 1) << (8 * j) for j in range(8)) for b in range(256)], np.uint64)


def fingerprints(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) uint64 fingerprints, and the number of distinct words, of a chunk of documents."""
    words = Words(buf, off)
    order = np.lexsort((words.hash, words.owner))
    owner, h = words.owner[order], words.hash[order]
    first = np.ones(len(h), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    owner, h = owner[first], h[first]
    n = len(off) - 1
    count = np.bincount(owner, minlength=n)
    out = np.zeros((n, BITS), np.int64)
    some = np.flatnonzero(count)
    if len(some):
        # eight counters of a byte each in a word: runs of at most 255 features can't overflow one
        start = (np.cumsum(count) - count)[some]
        runs = (count[some] + 254) // 255
        begin = np.repeat(start, runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
        begin_doc = np.cumsum(runs) - runs
        pair = np.stack([h, mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))], 1).view(np.uint8)
        for k in range(BITS // 8):
            lanes = np.add.reduceat(_LANES[pair[:, k]], begin).view(np.uint8).reshape(-1, 8)
            out[some, 8 * k : 8 * k + 8] = np.add.reduceat(lanes.astype(np.int64), begin_doc, axis=0)
    bits = np.packbits(2 * out > count[:, None], axis=1)
    return np.ascontiguousarray(bits).view(np.uint64), count


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


class Forest:
    """The BK-trees of many shards; `shard` is sorted and `points` are in order of insertion."""

    def __init__(self, points: np.ndarray, shard: np.ndarray):
        n = len(points)
        self.points = points
        first = np.ones(n, bool)
        first[1:] = shard[1:] != shard[:-1]
        self.root = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        self.levels = []
        left, at = np.flatnonzero(~first), self.root[~first]
        while len(left):
            # the first to come to a node by an edge becomes its child; the others go on to that child
            d = distance(points[left], points[at])
            slot = at * (BITS + 1) + d
            _, lead, inverse = np.unique(slot, return_index=True, return_inverse=True)
            child = left[lead]
            parent[child], edge[child] = at[lead], d[lead]
            self.levels.append(child)
            stay = np.ones(len(left), bool)
            stay[lead] = False
            left, at = left[stay], child[inverse[stay]]
        kids = np.flatnonzero(parent >= 0)
        slot = parent[kids] * (BITS + 1) + edge[kids]
        order = np.argsort(slot, kind="stable")
        self.kids, self.slots = kids[order], slot[order]
        self.parent, self.edge = parent, edge

    def near(self, radius: int, block: int = 1 << 15, queries: np.ndarray | None = None, skip: tuple[np.ndarray, ...] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pieces of (i, j) with i > j in one tree and at most `radius` apart, i being a query (every point is, if none are given).

        However many pairs there are, some `block` visits are held at once.  `skip`: the points' components, and the least and
        greatest ones below each node; nodes below which all are of the query's own component aren't looked at.
        """
        queries = np.arange(len(self.points)) if queries is None else queries
        for a in range(0, len(queries), block):
            q = queries[a : a + block]
            node, stack = self.root[q], []
            while True:
                d = distance(self.points[q], self.points[node])
                hit = (d <= radius) & (node < q)
                if hit.any():
                    yield q[hit], node[hit]
                lo = np.searchsorted(self.slots, node * (BITS + 1) + np.maximum(d - radius, 0), "left")
                c = np.searchsorted(self.slots, node * (BITS + 1) + np.minimum(d + radius, BITS), "right") - lo
                some = c > 0
                if some.any():
                    stack.append((q[some], lo[some], c[some]))
                if not stack:
                    break
                q, lo, c = stack.pop()
                k = max(1, int(np.searchsorted(np.cumsum(c), block, "right")))
                if k < len(q):
                    stack.append((q[k:], lo[k:], c[k:]))
                    q, lo, c = q[:k], lo[:k], c[:k]
                node = self.kids[np.repeat(lo, c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]
                q = np.repeat(q, c)
                # a later point is inserted below an earlier one, so a query never needs nodes that came after it
                ok = node < q
                if skip is not None:
                    label, low, high = skip
                    ok &= (low[node] != label[q]) | (high[node] != label[q])
                q, node = q[ok], node[ok]

    def pairs(self, radius: int, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
        """(i, j) with i > j in one tree and at most `radius` apart, every point being a query."""
        i, j = zip((np.zeros(0, np.int64), np.zeros(0, np.int64)), *self.near(radius, block))
        return np.concatenate(i), np.concatenate(j)

    def links(self, radius: int, block: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pieces of a spanning forest of pairs(): the same components from fewer pairs than points.

        The last point of each tree is a query first, then twice as many at a time, so that a dense group is one component
        after few queries, and the others needn't compare its points with each other.
        """
        label = np.arange(len(self.points))
        near = np.flatnonzero((self.parent >= 0) & (self.edge <= radius))
        yield join(label, near, self.parent[near])
        first = np.flatnonzero(self.root == label)
        size = np.diff(np.append(first, len(label)))
        turn = np.log2(np.repeat(first + size, size) - np.arange(len(label))).astype(np.int64)
        order = np.argsort(turn, kind="stable")
        for part in np.split(order, np.cumsum(np.bincount(turn))[:-1] if len(turn) else []):
            for a in range(0, len(part), block):
                low, high = label.copy(), label.copy()
                for level in reversed(self.levels):
                    np.minimum.at(low, self.parent[level], low[level])
                    np.maximum.at(high, self.parent[level], high[level])
                for i, j in self.near(radius, block, part[a : a + block], (label, low, high)):
                    new = label[i] != label[j]
                    if new.any():
                        yield join(label, i[new], j[new])


def join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins the components of i and j in `label` (the least point of each point's component); returns those pairs that it took."""
    took = [(i[:0], j[:0])]
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            break
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        high, low = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((low, high))
        lead = order[np.append(True, np.diff(high[order]) > 0)]
        label[high[lead]] = low[lead]
        took.append((i[lead], j[lead]))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
    i, j = zip(*took)
    return np.concatenate(i), np.concatenate(j)


def gathered(pieces: Iterator[tuple[np.ndarray, np.ndarray]], size: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of pairs put together to `size` or somewhat more."""
    held, n = [], 0
    for piece in pieces:
        held.append(piece)
        n += len(piece[0])
        if n >= size:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held))


def key_places(key_bits: int, tables: int) -> np.ndarray:
    """(tables, key_bits) places of bits: disjoint blocks of one permutation after another."""
    rng = np.random.Generator(np.random.PCG64(0xB17))
    per = BITS // key_bits
    rows = []
    while len(rows) < tables:
        p = rng.permutation(BITS)
        rows += [p[k * key_bits : (k + 1) * key_bits] for k in range(per)]
    return np.array(rows[:tables])


def layout(n: int, radius: int, recall: float) -> tuple[int, int]:
    """(key_bits, tables) for n distinct fingerprints."""
    key_bits = 16 + max(0, math.ceil(math.log2(max(n, 1))) - 24)
    p = (1 - radius / BITS) ** key_bits
    return key_bits, math.ceil(math.log(1 - recall) / math.log(1 - p))


def keys_of(points: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(n, tables) shard keys."""
    bits = np.unpackbits(points.view(np.uint8).reshape(len(points), -1), axis=1)
    weight = (1 << np.arange(places.shape[1], dtype=np.int64))[::-1]
    return np.stack([bits[:, p].astype(np.int64) @ weight for p in places], 1)


def _prints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a column of texts, and the numbers of their distinct words."""
    buf, off = flat(texts)
    fp, count = np.zeros((len(off) - 1, 2), np.uint64), np.zeros(len(off) - 1, np.int64)
    for a, b in chunks(off):
        fp[a:b], count[a:b] = fingerprints(buf[off[a] : off[b]], off[a : b + 1] - off[a])
    return fp, count


def _print_column(texts: pa.Array) -> pa.Array:
    """Fingerprints as structs of hi and lo, null where there is no word."""
    fp, count = _prints(texts)
    return pa.StructArray.from_arrays([signed(fp[:, 0]), signed(fp[:, 1])], ["hi", "lo"], mask=pa.array(count == 0))


def fingerprint_table(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hi, lo): one row for each document with a word."""

    def run(batches):
        for batch in batches:
            fp, count = _prints(batch["text"])
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(some)), signed(fp[some, 0]), signed(fp[some, 1])], ["id", "hi", "lo"])

    docs = need(documents, id_col, text_col).toDF("id", "text").where("id is not null and text is not null")
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, hi long, lo long")


def near_pairs(nodes: DataFrame, radius: int, n: int, recall: float, *, spanning: bool = False) -> DataFrame:
    """(a, b, distance), a < b, of nodes (rep, hi, lo) at most `radius` apart, each pair once.

    `spanning`: only as many of them as have the same components, fewer than the rows of all shards.
    """
    key_bits, tables = layout(n, radius, recall)
    places = key_places(key_bits, tables)
    masks = np.zeros((tables, BITS), np.uint8)
    np.put_along_axis(masks, places, 1, 1)
    masks = np.packbits(masks, axis=1).view(np.uint64)
    kind = nodes.schema["rep"].dataType.simpleString()

    def spread(batches):
        for batch in batches:
            points = np.stack([batch[c].to_numpy(zero_copy_only=False).view(np.uint64) for c in ("hi", "lo")], 1)
            keys = keys_of(points, places)
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array((keys[:, t] << 16) | t), batch["rep"], batch["hi"], batch["lo"]], ["shard", "rep", "hi", "lo"])

    def search(batches):
        held, size, last = [], 0, None
        for batch in batches:
            if not len(batch):
                continue
            shard = batch["shard"].to_numpy()
            cut = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
            if size + len(batch) >= 200_000 and held and (cut or shard[0] != last):
                yield from probe(pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held))
                held, size = [batch.slice(cut)], len(batch) - cut
            else:
                held.append(batch)
                size += len(batch)
            last = shard[-1]
        if held:
            yield from probe(pa.Table.from_batches(held))

    def probe(table):
        shard = table["shard"].to_numpy()
        points = np.stack([table[c].to_numpy().view(np.uint64) for c in ("hi", "lo")], 1)
        rep = table["rep"].combine_chunks()
        forest = Forest(points, shard)
        for i, j in gathered(forest.links(radius) if spanning else forest.near(radius)):
            # the pair belongs to the first table under whose key it agrees; of a spanning forest, that table's own joins its ends too
            differ = points[i] ^ points[j]
            first = np.full(len(i), tables)
            for t in range(tables - 1, -1, -1):
                first[~(differ & masks[t]).any(1)] = t
            own = first == (shard[i] & 0xFFFF)
            i, j = i[own], j[own]
            d = distance(points[i], points[j])
            yield pa.RecordBatch.from_arrays([rep.take(pa.array(i)), rep.take(pa.array(j)), pa.array(d, pa.int32())], ["a", "b", "distance"])

    # each task sorts its own rows for the shuffle, so it is given a bounded number of them
    rows = nodes.select("rep", "hi", "lo").repartition(max(1, math.ceil(n * tables / SPREAD_ROWS)))
    rows = rows.mapInArrow(spread, f"shard long, rep {kind}, hi long, lo long")
    rows = rows.repartition("shard").sortWithinPartitions("shard", "rep")
    found = rows.mapInArrow(search, f"a {kind}, b {kind}, distance int")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node of its component."""
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: larger neighbours go to the least of a node and its neighbours
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours and the node itself go to the least
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        new = written(small.distinct(), "edges")
        same = new.count() == edges.count() and new.join(edges, ["a", "b"], "left_anti").isEmpty()
        if same:
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = new


def _grouped(documents: DataFrame, radius: int, recall: float, id_col: str, text_col: str) -> DataFrame:
    """(id, hi, lo, kept) of each document that is in a group of two or more; kept has the id and the fingerprint of the one that stays."""
    docs = written(fingerprint_table(documents, id_col=id_col, text_col=text_col).distinct(), "prints")
    nodes = docs.groupBy("hi", "lo").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    pairs = written(near_pairs(nodes.select(F.col("node").alias("rep"), "hi", "lo"), radius, nodes.count(), recall, spanning=True), "pairs")
    roots = components(pairs)
    roots = roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()
    member = nodes.join(roots, "node", "left").where("n > 1 or root is not null")
    member = member.select("hi", "lo", "id", "n", F.coalesce("root", "node").alias("root"))
    kept = member.groupBy("root").agg(F.min(F.struct("id", "hi", "lo")).alias("kept"))
    return docs.join(member.join(kept, "root").select("hi", "lo", "kept"), ["hi", "lo"]).select("id", "hi", "lo", "kept")


def groups(documents: DataFrame, *, radius: int = RADIUS, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, distance) of each document that is in a group of two or more; keep_id is the least id of its group.

    `distance` is to the fingerprint of the document that stays; it may exceed the radius where near copies form a chain.
    """
    rows = _grouped(documents, radius, recall, id_col, text_col)
    bits = F.bit_count(F.col("hi").bitwiseXOR(F.col("kept.hi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("kept.lo")))
    rows = rows.groupBy("id", F.col("kept.id").alias("keep")).agg(F.min(bits).cast("int").alias("distance"))
    return rows.toDF(id_col, "keep_id", "distance")


def _listed(table: DataFrame, key: str, tag: str) -> Callable[[Column], Column]:
    """Whether a key is in the table, by a map over the keys alone: rows keep their place, and their texts aren't shuffled."""
    known = DigestArray.store(table, key, None, tag)

    def has(keys: pa.Array) -> pa.Array:
        return pa.array(known.has(keys.to_numpy(zero_copy_only=False).view(np.uint64)))

    return F.arrow_udf(has, "boolean")


def drop_copies(documents: DataFrame, *, radius: int = RADIUS, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, and all the others; columns stay, and a row that repeats an id and its fingerprint goes."""
    found = _grouped(documents, radius, recall, id_col, text_col)
    gone = written(found.where("id <> kept.id or hi <> kept.hi or lo <> kept.lo").select("id", "hi", "lo"), "gone")
    key = F.xxhash64(documents[id_col])
    again = documents.where(documents[id_col].isNotNull()).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    again = written(again, "again")
    # a key of one row alone tells that row, whatever its id
    drops = _listed(gone.select(F.xxhash64("id").alias("key")), "key", "gone-keys")(key)
    if again.isEmpty():
        return documents.where(documents[id_col].isNull() | ~drops)
    # ids of several rows, and other ids of one key, are told apart by id and fingerprint
    several = _listed(again, "key", "again-keys")(key)
    once = documents.where(documents[id_col].isNull() | (~several & ~drops))
    more = documents.where(documents[id_col].isNotNull() & several)
    more = more.select(F.struct("*").alias("row"), more[id_col].alias("id"), more[text_col].alias("text"), F.arrow_udf(_print_column, "struct<hi:long,lo:long>")(more[text_col]).alias("fp"))
    more = more.join(gone.toDF("gone", "hi", "lo"), (F.col("id") == F.col("gone")) & (F.col("fp.hi") == F.col("hi")) & (F.col("fp.lo") == F.col("lo")), "left_anti")
    place = F.row_number().over(Window.partitionBy("id", "fp").orderBy("text", F.to_json("row")))
    more = more.withColumn("place", place).where("place = 1 or fp is null")
    return once.union(more.select("row.*"))
