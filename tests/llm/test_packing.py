import itertools
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillet.llm import packing as B
from quillet.llm import textops as T
from quillet.llm import tokens as K


def naive_best_fit(sizes, capacity):
    bins, out = [], []
    for s in sizes:
        rooms = [(capacity - b, i) for i, b in enumerate(bins) if b + s <= capacity]
        if rooms:
            i = min(rooms)[1]
            bins[i] += s
        else:
            i = len(bins)
            bins.append(s)
        out.append(i)
    return bins, out


def optimum(sizes, capacity):
    """Least bins, by trying all ways."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room + sizes[i] <= capacity:
                rest = list(bins)
                rest.remove(room)
                go(i + 1, rest + [room + sizes[i]])
        go(i + 1, bins + [sizes[i]])

    go(0, [])
    return best[0]


def test_best_fit_like_a_loop():
    rng = random.Random(1)
    for _ in range(200):
        c = rng.randrange(1, 40)
        sizes = sorted((rng.randrange(1, c + 1) for _ in range(rng.randrange(60))), reverse=True)
        bins, _ = naive_best_fit(sizes, c)
        got = B.best_fit(sizes, c)
        assert sorted(np.bincount(got, sizes).astype(int)) == sorted(bins) if sizes else len(got) == 0


def test_bound_never_exceeds_the_optimum_and_is_often_it():
    rng, tight = random.Random(2), 0
    for _ in range(200):
        c = rng.randrange(4, 24)
        sizes = [rng.randrange(1, c + 1) for _ in range(rng.randrange(1, 9))]
        bound, best = B.lower_bound(np.bincount(sizes, minlength=c + 1)), optimum(sizes, c)
        assert bound <= best
        tight += bound == best
    assert tight > 180
    # more than the sum shows
    assert B.lower_bound(np.bincount([6, 6, 6], minlength=11)) == 3
    assert B.lower_bound(np.bincount([4] * 6, minlength=11)) == 3


def test_token_counts_are_exact():
    rng = random.Random(3)
    alphabet = list("abcXYZ 019.,'\n\t  ") + ["é", "ß", "字", " ", " ", "😀", "'s", " 'll", "　", "\x1c", "\u0085", "ѐ"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(90))) for _ in range(800)] + ["", " ", "\n\n", None, "a" * 9000]
    buf, off = T.flat(pa.array(texts))
    want = [len(K.encoder().encode_ordinary(t or "")) for t in texts]
    assert K.count_chunk(buf, off).tolist() == want
    assert K.count_chunk(buf, off).tolist() == want


def check(rows, capacity, lengths):
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        if r.n_tokens:
            bins[r.bin_id].append(r)
        else:
            assert r.bin_id is None
    for rs in bins.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.position):
            assert r.position == at
            at += r.n_tokens
        assert at <= capacity
    per = {r.partition: r for r in rows if r.n_tokens}
    assert sum(r.partition_bins for r in per.values()) == len(bins)
    for p, r in per.items():
        mine = [x.n_tokens for x in rows if x.partition == p]
        assert r.partition_bound == B.lower_bound(np.bincount(mine, minlength=capacity + 1)) <= r.partition_bins
        assert len({x.bin_id for x in rows if x.partition == p}) == r.partition_bins
    for d, n in lengths.items():
        assert sum(r.n_tokens for r in pieces[d]) == sum(n)
    return bins


def test_pieces_bins_and_exchange(spark):
    rng = random.Random(4)
    texts = [(i, " ".join("ab" for _ in range(rng.randrange(1, 60)))) for i in range(900)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    lengths = {i: [len(K.encoder().encode_ordinary(t))] for i, t in texts}
    alone = B.pack(df, capacity=40, per_partition=30, fan_in=10**6).collect()
    bins = check(B.pack(df, capacity=40, per_partition=30, fan_in=4).collect(), 40, lengths)
    assert len(check(alone, 40, lengths)) >= -(-sum(n[0] for n in lengths.values()) // 40)
    first = [naive_best_fit(sorted((r.n_tokens for r in rs), reverse=True), 40) for _, rs in itertools.groupby(sorted((r for r in alone if r.n_tokens), key=lambda r: r.partition), key=lambda r: r.partition)]
    assert len(bins) <= sum(len(b) for b, _ in first) + 5
    merged = {r.partition for r in alone if r.n_tokens and r.partition < 0}
    assert merged  # some partitions had gaps and exchanged


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "two words"), (4, "word " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bin", F.lit(1)).withColumn("id", F.lit(1)).withColumn("n", F.lit(1))
    out = B.pack(df, capacity=128).collect()
    n = len(K.encoder().encode_ordinary("word " * 20_000))
    check(out, 128, {1: [0], 2: [0], 3: [1, 1], 4: [n]})
    assert [r.n_tokens for r in out if r.doc_id in (1, 2)] == [0, 0]
    assert sorted(r.piece for r in out if r.doc_id == 4) == list(range(-(-n // 128)))
    assert B.pack(df.limit(0)).count() == 0
