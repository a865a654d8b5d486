"""Chat formatting as prefix trees.

Conversations that begin with the same turns are merged: a node is a distinct sequence of
turns, and its tokens (those of its last turn in chat markup) are emitted once, depth first. A tree, that is, all
conversations with one first turn, is a single token sequence. Each node carries its tokens' position ids, which count along
the path from the root as if the conversation stood alone, and the intervals of the sequence that
hold its ancestors: a token may attend to those and to its own node up to itself.

A node belongs to the least of its conversations, so a conversation's own nodes are the last ones of its path: its *segment*,
which hangs below a node of another segment, or is the root's. Depth-first order follows each segment to its end
and then its branches, the deepest first: a sort of segments by path, the list of the places
where, from the root on, the path goes over to another segment. A parent's path is a prefix of its children's.

Scale: rows of turns (50 bytes each: digests and token counts, never texts) are shuffled three times: by conversation, where they are chained to nodes by a stream of
sorted rows, by node, and by conversation again, where they are cut into segments. All arrays are of a conversation's own nodes or of
its branchings, so a conversation of thousands of turns costs no more than as many short ones. Offsets are prefix sums in two steps over range partitions
of segments, so a tree that holds most conversations (one system prompt for all) is spread over many tasks. A last map
over the conversations looks its segment up in a memory-mapped digest array and tokenises the texts of own nodes, where they stand.

Defined results: a row with a null conversation id or turn number is left out; a null role or text counts as an empty
one; a repeated row counts once; several texts under one turn number follow each other in the order of role
and digest. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import json
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import DigestArray, discard, need, written
from .textops import lists
from .tokens import VOCABULARY, encoder, token_count

#: Markup of a turn.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"

_OUT = "tree string, node string, parent string, depth int, conv {kind}, n_conversations long, start long, tokens array<int>, position_ids array<int>, attention array<struct<start:long,stop:long>>"


def markup(role, text):
    """The text of a turn in chat markup."""
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, digest, key, told): told is the turn in markup, key names it in its conversation."""
    rows = need(conversations, conv_col, turn_col, role_col, text_col).toDF("conv", "turn", "role", "text").where("conv is not null and turn is not null")
    rows = rows.select("conv", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    rows = rows.select("conv", "turn", "role", digest.alias("digest"), markup(F.col("role"), F.col("text")).alias("told"))
    return rows.withColumn("key", F.xxhash64("turn", "digest"))


def steps(turns: DataFrame, vocabulary: str) -> DataFrame:
    """(conv, depth, key, n, node, again) of each distinct turn; node is the digest of the turns so far, `again` tells of a repeated row."""
    kind = turns.schema["conv"].dataType.simpleString()

    def chain(batches):
        conv = turn = node = held = None
        depth = 0
        out: list[tuple] = []
        for batch in batches:
            for c, t, r, d, k, n in zip(*(batch[x].to_pylist() for x in ("conv", "turn", "role", "digest", "key", "n"))):
                if c == conv and (t, r, d) == turn:
                    held = (*held[:5], True)
                    continue
                if held is not None:
                    out.append(held)
                node, depth = (md5(d).digest(), 0) if c != conv else (md5(node + d).digest(), depth + 1)
                conv, turn, held = c, (t, r, d), (c, depth, k, n, node, False)
            if len(out) >= 2000:
                yield table(out)
                out = []
        if held is not None:
            yield table([*out, held])

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["conv", "depth", "key", "n", "node", "again"])

    rows = turns.select("conv", "turn", "role", "digest", "key", token_count("told", vocabulary).cast("int").alias("n"))
    types = [None, pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()]
    return rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest").mapInArrow(chain, f"conv {kind}, depth int, key long, n int, node binary, again boolean")


def segments(nodes: DataFrame) -> DataFrame:
    """A row for each conversation with nodes of its own; nodes are (conv, depth, key, n, node, again, first, shared).

    depth, parent and position are those of the first own node; hops are the segments above it, and how many tokens of each are; path has their depths, negative, and
    conversations, its own last.
    """
    kind = nodes.schema["conv"].dataType.simpleString()
    names = ["conv", "tree", "parent", "depth", "position", "tokens", "path", "hops", "keys", "ns", "nodes", "shared", "again"]

    def cut(batches):
        rows: list[tuple] = []
        own: list[dict] = []
        for batch in batches:
            for row in zip(*(batch[x].to_pylist() for x in ("conv", "depth", "key", "n", "node", "again", "first", "shared"))):
                if rows and row[0] != rows[0][0]:
                    own += segment(rows)
                    rows = []
                    if len(own) >= 500:
                        yield table(own)
                        own = []
                rows.append(row)
        own += segment(rows) if rows else []
        if own:
            yield table(own)

    def segment(rows):
        conv = rows[0][0]
        first = next((i for i, r in enumerate(rows) if r[6] == conv), None)
        if first is None:
            return []
        path, hops = [], []
        for _, depth, _, n, _, _, owner, _ in rows[:first]:
            if not hops or hops[-1][0] != owner:
                path.append((-depth, owner))
                hops.append([owner, 0])
            hops[-1][1] += n
        mine = rows[first:]
        return [(conv, rows[0][4], rows[first - 1][4] if first else None, rows[first][1], sum(n for _, n in hops), sum(r[3] for r in mine), [*path, (-rows[first][1], conv)], hops, *([r[k] for r in mine] for k in (2, 3, 4, 7, 5)))]

    def table(rows):
        c = list(zip(*rows))
        pairs = lambda x, a, b: [[{a: i, b: j} for i, j in y] for y in x]
        c[6], c[7] = pairs(c[6], "d", "c"), pairs(c[7], "c", "n")
        id_type = pa.array(c[0]).type
        types = [None, pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.struct([("d", pa.int32()), ("c", id_type)])), pa.list_(pa.struct([("c", id_type), ("n", pa.int64())])), *(pa.list_(t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.bool_()))]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types)], names)

    out = f"conv {kind}, tree binary, parent binary, depth int, position long, tokens long, path array<struct<d:int,c:{kind}>>, hops array<struct<c:{kind},n:long>>, keys array<long>, ns array<int>, nodes array<binary>, shared array<long>, again array<boolean>"
    return nodes.repartition("conv").sortWithinPartitions("conv", "depth").mapInArrow(cut, out)


def _starts(own: DataFrame) -> DataFrame:
    """(conv, start): the place of each segment's first token in its tree's sequence."""
    order = own.select("conv", "tree", "path", "tokens").repartitionByRange("tree", "path").withColumn("part", F.spark_partition_id())
    order = written(order, "order")
    # prefix sums: of the parts of a tree first, then within each part
    parts = order.groupBy("tree", "part").agg(F.sum("tokens").alias("s"))
    before = F.sum("s").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("tree", "part", F.coalesce(before, F.lit(0)).alias("base"))
    within = F.sum("tokens").over(Window.partitionBy("tree", "part").orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    return written(order.join(parts, ["tree", "part"]).select("conv", (F.col("base") + F.coalesce(within, F.lit(0))).alias("start")), "starts")


def forest(conversations: DataFrame, *, vocabulary: str = VOCABULARY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(tree, node, parent, depth, conv_id, n_conversations, start, tokens, position_ids, attention) of every node.

    conv_id is the least of the node's conversations, start the place of its first token in its tree's sequence, attention
    the intervals [start, stop) of the tree's sequence that hold its ancestors' tokens, neighbouring ones joined.
    """
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col)
    kind = turns.schema["conv"].dataType.simpleString()
    each = written(steps(turns, vocabulary), "steps")
    nodes = each.groupBy("node").agg(F.min("conv").alias("first"), F.count(F.lit(1)).alias("shared"))
    own = written(segments(each.join(nodes, "node")), "segments")
    discard(each)
    starts = _starts(own)
    hops = own.select("conv", F.posexplode("hops").alias("i", "h")).join(starts.withColumnRenamed("conv", "above"), F.col("h.c") == F.col("above"))
    hops = hops.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("i", "start", (F.col("start") + F.col("h.n")).alias("stop")))).alias("seen"))
    told = own.drop("path", "hops", "tokens").join(starts, "conv").join(hops, "conv", "left")
    told = told.select(F.xxhash64("conv").alias("k"), F.to_json(F.struct(F.col("conv").cast("string").alias("conv"), *told.columns[1:])).alias("v"))
    known = DigestArray.store(told, "k", "v", "segments", per_file=1 << 14, rows=own.count())
    source = turns.select("conv", F.col("conv").cast("string").alias("name"), F.xxhash64("conv").alias("k"), "key", "told")

    def emit(again: bool):
        def run(batches):
            enc = encoder(vocabulary)
            for batch in batches:
                _, where = known.find(np.unique(batch["k"].to_numpy(zero_copy_only=False).view(np.uint64)))
                found = {}
                for v in known.values(where).to_pylist():
                    v = json.loads(v)
                    found[v["conv"]] = v, {k: i for i, k in enumerate(v["keys"]) if v["again"][i] == again}
                here, out, tokens = [], [], []
                for row, (name, key, text) in enumerate(zip(batch["name"].to_pylist(), batch["key"].to_pylist(), batch["told"].to_pylist())):
                    v, places = found.get(name, (None, {}))
                    i = places.get(key)
                    if i is None:
                        continue
                    here.append(row)
                    if "places" not in v:
                        v["places"] = np.append(0, np.cumsum(v["ns"])).tolist()
                        v["hex"] = [base64.b64decode(x).hex() for x in (v["tree"], v.get("parent") or "", *v["nodes"])]
                    ids = enc.encode_ordinary(text)
                    tokens.append(np.array(ids, np.int32))
                    start, done = v["start"] + v["places"][i], v["places"][i]
                    seen: list[dict] = []
                    for a, b in [*((x["start"], x["stop"]) for x in v.get("seen") or []), (v["start"], start)]:
                        if seen and seen[-1]["stop"] == a:
                            seen[-1]["stop"] = b
                        elif a < b:
                            seen.append({"start": a, "stop": b})
                    out.append((v["hex"][0], v["hex"][i + 2], v["hex"][i + 1] or None, v["depth"] + i, v["shared"][i], start, v["position"] + done, seen))
                if not here:
                    continue
                tree, node, parent, depth, shared, start, position, seen = zip(*out)
                size = np.array([len(t) for t in tokens])
                flat_ = np.concatenate(tokens)
                first = np.repeat(np.array(position) - np.cumsum(size) + size, size)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x, pa.string()) for x in (tree, node, parent)), pa.array(depth, pa.int32()), batch["conv"].take(pa.array(here)), pa.array(shared, pa.int64()), pa.array(start, pa.int64())]
                    + [lists(pa.array(flat_), size), lists(pa.array((first + np.arange(len(flat_))).astype(np.int32)), size), pa.array(seen, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                    ["tree", "node", "parent", "depth", "conv", "n_conversations", "start", "tokens", "position_ids", "attention"],
                )

        return source.mapInArrow(run, _OUT.format(kind=kind))

    out = emit(False)
    if not own.where(F.exists("again", lambda x: x)).isEmpty():
        out = out.unionByName(emit(True).dropDuplicates(["node"]))
    return out.withColumnRenamed("conv", conv_col)
