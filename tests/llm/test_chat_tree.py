from collections import defaultdict

from pyspark.sql import functions as F

from quillet.llm import chat_tree as C
from quillet.llm.tokens import encoder


def rebuilt(rows):
    """Each tree's sequence, from its nodes."""
    out = defaultdict(dict)
    for r in rows:
        for i, t in enumerate(r.tokens):
            assert r.start + i not in out[r.tree]
            out[r.tree][r.start + i] = (t, r.position_ids[i], r, i)
    return out


def check(rows, conversations):
    """Every conversation's tokens and positions are what attention and its leaf give."""
    enc, nodes, sequence = encoder(), {r.node: r for r in rows}, rebuilt(rows)
    for tree, s in sequence.items():
        assert sorted(s) == list(range(len(s)))
    want = {tuple(t for role, text in turns for t in enc.encode_ordinary(f"<|im_start|>{role}\n{text}<|im_end|>\n")) for turns in conversations.values()}
    told = set()
    for r in rows:
        chain, n = [], r
        while n is not None:
            chain.append(n)
            n = nodes[n.parent] if n.parent else None
        chain.reverse()
        tokens = [t for n in chain for t in n.tokens]
        assert [p for n in chain for p in n.position_ids] == list(range(len(tokens)))
        seen = {i for a in r.attention for i in range(a.start, a.stop)}
        assert seen == {i for n in chain[:-1] for i in range(n.start, n.start + len(n.tokens))}
        assert all(a.stop < b.start for a, b in zip(r.attention, r.attention[1:]))
        told.add(tuple(tokens))
    assert want <= told
    # shared turns are emitted once
    prefixes = {tuple(turns[: i + 1]) for turns in conversations.values() for i in range(len(turns))}
    assert len(rows) == len(prefixes)


def test_shared_turns_once_depth_first(spark):
    convs = {1: ["s", "a", "b"], 2: ["s", "a", "c"], 3: ["s", "d"], 4: ["t", "a"], 5: ["s", "a", "b"], 6: ["s", "a"], 7: ["s", "a", "c", "e " * 3000]}
    rows = [(c, i, "user" if i % 2 else "system", t, 0) for c, ts in convs.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows + rows[:3], "conv_id long, turn long, role string, text string, node int").withColumn("n", F.lit(1))
    out = C.forest(df).collect()
    check(out, {c: [("user" if i % 2 else "system", t) for i, t in enumerate(ts)] for c, ts in convs.items()})
    assert max(r.n_conversations for r in out) == 6


def test_nulls_empty_texts_and_no_rows(spark):
    df = spark.createDataFrame([(1, 0, None, None), (1, 1, "user", ""), (None, 0, "user", "x"), (2, None, "user", "x"), (3, 0, "", "")], "conv_id long, turn long, role string, text string")
    out = C.forest(df).collect()
    check(out, {1: [("", ""), ("user", "")], 3: [("", "")]})
    assert C.forest(df.limit(0)).count() == 0


def test_whole_table(spark, small):
    df = spark.read.parquet(f"{small}/conversations.parquet")
    convs = defaultdict(list)
    for r in df.orderBy("conv_id", "turn").collect():
        convs[r.conv_id].append((r.role, r.text))
    check(C.forest(df).collect(), convs)


def test_random_trees_with_branches_on_branches(spark):
    """Branches at many depths, copies, repeated rows and turns of one number: depth-first, each branch behind its parent."""
    import random

    rng = random.Random(7)
    convs = {0: [f"t{i}" for i in range(12)]}
    for c in range(1, 150):
        base = convs[rng.randrange(max(0, c - 20), c)]
        convs[c] = [*base[: rng.randrange(0, len(base) + 1)], *(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 5)))]
    rows = [(str(c), i, "user" if i % 2 else "system", t) for c, ts in convs.items() for i, t in enumerate(ts)]
    rows += rng.sample(rows, 60)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    out = C.forest(df).collect()
    check(out, {c: [("user" if i % 2 else "system", t) for i, t in enumerate(ts)] for c, ts in convs.items()})
    # the order is that of the lists of least conversations from the root on
    nodes = {r.node: r for r in out}

    def firsts(r):
        return (firsts(nodes[r.parent]) if r.parent else []) + [r.conv_id]

    for tree in {r.tree for r in out}:
        own = sorted((r for r in out if r.tree == tree), key=lambda r: r.start)
        assert [firsts(r) for r in own] == sorted(firsts(r) for r in own)


def test_a_long_conversation_and_one_root_for_all(spark):
    """5,000 turns in one conversation, of which another branches off late; one system prompt for 3,000 conversations."""
    long = [(0, i, "user", f"turn {i}") for i in range(5000)]
    late = [(1, i, t[2], t[3]) for i, t in enumerate(long[:4990])] + [(1, 4990, "user", "other")]
    many = [x for c in range(2, 3002) for x in ((c, 0, "system", "be kind"), (c, 1, "user", f"question {c % 1500}"))]
    out = C.forest(spark.createDataFrame(long + late + many, "conv_id long, turn long, role string, text string")).collect()
    assert len(out) == 5001 + 1501
    root = [r for r in out if r.n_conversations == 3000]
    assert len(root) == 1 and root[0].start == 0 and root[0].conv_id == 2
    below = sorted((r for r in out if r.parent == root[0].node), key=lambda r: r.start)
    assert len(below) == 1500 and all([(a.start, a.stop) for a in r.attention] == [(0, len(root[0].tokens))] for r in below)
    assert all(a.start + len(a.tokens) == b.start for a, b in zip(below, below[1:]))
    other = next(r for r in out if r.depth == 4990 and r.conv_id == 1)
    last = max((r for r in out if r.conv_id == 0), key=lambda r: r.depth)
    assert other.start == last.start + len(last.tokens) and other.attention[0].start == 0 and other.position_ids[0] == other.attention[0].stop
