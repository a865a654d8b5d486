"""Best-fit packing of documents into token sequences, with certified bin counts.

Documents are cut into pieces of at most `capacity` tokens; each partition packs its
pieces by best-fit decreasing.  Dual feasible functions (the identity, the rounding
functions u(k), the threshold functions U(e) and phi(e) of Fekete and Schepers) give a lower bound of the bins
that any packing of the partition needs, so a partition whose bins equal its bound
is certified optimal.  Partitions with a gap exchange documents: `fan_in` of
them pool the pieces of their bins that aren't full and rerun best-fit decreasing on these; the result
replaces the old bins if it needs fewer.  The merged partition's bound is that of all its
pieces.  Rounds go on until no gap, or one partition, is left.

Scale: the texts are read once, to count tokens; all else handles (id, piece, length) rows.
A partition has about `per_partition` pieces whatever the input; an exchange pools only
open bins, of which best fit leaves few.

Defined results: a null or empty text, or one without tokens, has no room to fill: one row with
no bin (null); a piece that fills a sequence is a bin of its own; rows that repeat an id are packed each;
a null id is packed like any other; an empty table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import need, written
from .tokens import VOCABULARY, token_count

CAPACITY = 2048
PER_PARTITION = 20_000
FAN_IN = 8


def best_fit(sizes, capacity: int) -> np.ndarray:
    """The bin of each size, sizes being in falling order."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins, out = 0, 0, np.zeros(len(sizes), np.int64)
    for i, size in enumerate(sizes):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, bins
            bins += 1
        left = room - size
        if left:
            open_bins[left].append(b)
            mask |= 1 << left
        out[i] = b
    return out


def lower_bound(histogram: np.ndarray) -> int:
    """Bins that pieces need at least, by dual feasible functions; histogram[n] pieces have n tokens, n at most the capacity."""
    count = np.asarray(histogram, np.int64)
    c = len(count) - 1
    n = np.arange(c + 1)
    best = -(-int((count * n).sum()) // c)
    total, weight = np.cumsum(count), np.cumsum(count * n)
    sizes = np.flatnonzero(count)
    for e in sizes[(sizes > 0) & (2 * sizes <= c)].tolist():
        # U(e): sizes above c - e count as whole bins, those below e as nothing
        big = total[c] - total[c - e]
        best = max(best, int(big) - (-int(weight[c - e] - weight[e - 1]) // c))
        # phi(e): in units of 1 / floor(c / e)
        k = c // e
        top = total[c] - total[c - e]
        mid = np.arange(c // 2 + 1, c - e + 1)
        units = k * int(top) + int((count[mid] * (k - (c - mid) // e)).sum()) + int(total[c // 2] - total[e - 1])
        best = max(best, -(-units // k))
    for k in range(1, 64):
        # u(k): x if (k + 1) x is whole, else floor((k + 1) x) / k, in units of 1 / (k c)
        y = (k + 1) * n
        value = np.where(y % c == 0, k * n, y // c * c)
        best = max(best, -(-int((count * value).sum()) // (k * c)))
    return best


_PACKED = "id {kind}, piece int, n int, owner long, bin string, position int, fill int"


def pieces(documents: DataFrame, capacity: int, vocabulary: str, *, id_col: str, text_col: str) -> DataFrame:
    """(id, row, piece, n) for each piece, one with n = 0 for a document without tokens."""
    docs = need(documents, id_col, text_col).toDF("id", "text").select("id", token_count("text", vocabulary).alias("total"))
    docs = written(docs.withColumn("row", F.monotonically_increasing_id()), "tokens")
    last = F.greatest(F.ceil(F.col("total") / capacity) - 1, F.lit(0)).cast("int")
    rows = docs.select("id", "row", "total", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    return rows.select("id", "row", "piece", F.least(F.lit(capacity), F.col("total") - F.col("piece") * F.lit(capacity)).cast("int").alias("n"))


def _order(table: pa.Table) -> pa.Table:
    return table.sort_by([("n", "descending"), ("id", "ascending"), ("piece", "ascending")])


def _pack(table: pa.Table, capacity: int, owner: int, name: str) -> pa.Table:
    table = _order(table)
    n = table["n"].to_numpy().astype(np.int64)
    bins = best_fit(n.tolist(), capacity)
    order = np.argsort(bins, kind="stable")
    b, size = bins[order], n[order]
    ends = np.cumsum(size)
    first = np.append(True, b[1:] != b[:-1])
    position = np.empty(len(n), np.int64)
    position[order] = ends - size - np.maximum.accumulate(np.where(first, ends - size, 0))
    fill = np.bincount(bins, n)
    return pa.table(
        {
            "id": table["id"],
            "piece": table["piece"],
            "n": table["n"],
            "owner": pa.array(np.full(len(n), owner)),
            "bin": pa.array([f"{name}-{k}" for k in bins.tolist()]),
            "position": pa.array(position, pa.int32()),
            "fill": pa.array(fill[bins], pa.int32()),
        }
    )


def pack(documents: DataFrame, *, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, per_partition: int = PER_PARTITION, fan_in: int = FAN_IN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, n_tokens, bin_id, position, partition, partition_bins, partition_bound) of every piece.

    Pieces are numbered from 0 in the document's order; position is the piece's first token's place in its bin.
    partition_bound is the certified least number of bins for the pieces of the partition, partition_bins the number used.
    """
    cut = written(pieces(documents, capacity, vocabulary, id_col=id_col, text_col=text_col), "pieces")
    kind = cut.schema["id"].dataType.simpleString()
    full = cut.where("n > 0")
    parts = max(1, -(-full.count() // per_partition))
    packed_type = _PACKED.format(kind=kind)

    def first(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        k = keys[0].as_py()
        return _pack(table, capacity, k, f"0-{k}")

    keyed = full.withColumn("owner", F.pmod(F.xxhash64("id", "piece", "row"), F.lit(parts))).drop("row")  # rows of one id, or of none, are spread too
    now = written(keyed.groupBy("owner").applyInArrow(first, packed_type), "packed")

    def bound(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        histogram = np.bincount(table["n"].to_numpy(), table["c"].to_numpy(), capacity + 1).astype(np.int64)
        return pa.table({"owner": [keys[0].as_py()], "bound": [lower_bound(histogram)]})

    def statistics(rows: DataFrame) -> DataFrame:
        bins = rows.groupBy("owner").agg(F.count_if(F.col("position") == 0).alias("bins"))
        bounds = rows.groupBy("owner", "n").agg(F.count(F.lit(1)).alias("c")).groupBy("owner").applyInArrow(bound, "owner long, bound long")
        return written(bins.join(bounds, "owner"), "bins")

    stats = statistics(now)
    for round_no in range(1, 64):
        gaps = stats.where("bins > bound")
        n_gaps = gaps.count()
        if n_gaps < 2:
            break

        # one row for each partition of per_partition pieces, so one task can rank them
        ranks = gaps.select("owner", F.percent_rank().over(Window.orderBy("owner")).alias("r"))
        into = max(1, -(-n_gaps // fan_in))
        target = written(ranks.select("owner", F.least(F.floor(F.col("r") * into), F.lit(into - 1)).cast("long").alias("target")), "targets")

        moved = now.join(target, "owner").drop("owner")
        whole = moved.where(F.col("fill") == capacity).withColumn("owner", -(F.col("target") + F.lit(round_no * (1 << 32)))).drop("target")
        part = moved.where(F.col("fill") < capacity).groupBy("target").applyInArrow(_exchanger(capacity, round_no), packed_type)
        still = now.join(target, "owner", "left_anti")
        now = written(still.unionByName(whole).unionByName(part), "packed")
        stats = statistics(now)

    out = now.join(stats, "owner").select(F.col("id").alias(id_col), "piece", F.col("n").alias("n_tokens"), F.col("bin").alias("bin_id"), "position", F.col("owner").alias("partition"), F.col("bins").alias("partition_bins"), F.col("bound").alias("partition_bound"))
    bare = cut.where("n = 0").select(F.col("id").alias(id_col), "piece", F.col("n").alias("n_tokens"), *[F.lit(None).cast(t).alias(c) for c, t in out.dtypes[3:]])
    return out.unionByName(bare)


def _exchanger(capacity: int, round_no: int):
    """Packs pooled open bins anew, or leaves them as they were if that takes no fewer."""

    def again(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        k = keys[0].as_py()
        owner = -(round_no * (1 << 32) + k)
        new = _pack(table.select(["id", "piece", "n"]), capacity, owner, f"{round_no}-{k}")
        if len(new["bin"].unique()) < len(table["bin"].unique()):
            return new
        return table.select(["id", "piece", "n", "bin", "position", "fill"]).add_column(3, "owner", pa.array(np.full(len(table), owner)))

    return again
