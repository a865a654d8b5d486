import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillet.llm import textops as T
from quillet.llm import winnow as W


def naive(text, k, w):
    kept = [(i, c.lower() if len(c.lower()) == 1 else c) for i, c in enumerate(text) if c.isalnum()]
    value = lambda c: T.mix(np.array([ord(c) + 1], np.uint64))[0] | np.uint64(1)
    h = [int(T.grams(np.array([value(c) for _, c in kept[i : i + k]], np.uint64), k)[0]) for i in range(len(kept) - k + 1)]
    if not h:
        return []
    picked = set()
    for i in range(max(1, len(h) - w + 1)):
        window = h[i : i + w]
        picked.add(max(j for j in range(i, i + len(window)) if h[j] == min(window)))
    return [(h[j], kept[j][0]) for j in sorted(picked)]


def found(texts, k, w):
    buf, off = T.flat(pa.array(texts))
    h, at, owner = W.chunk_fingerprints(buf, off, k, w)
    return [[(int(a), int(b)) for a, b, o in zip(h, at, owner) if o == d] for d in range(len(texts))]


def test_like_a_loop():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abÄ é1,.\n字") for _ in range(rng.randrange(60))) for _ in range(80)] + ["", "a" * 50, "ab" * 30, None, "ſİß" * 9]
    for k, w in ((3, 4), (1, 1), (5, 9)):
        assert found(texts, k, w) == [naive(t or "", k, w) for t in texts]


def test_match_guarantee():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for _ in range(50):
        k, w = rng.randrange(2, 8), rng.randrange(1, 9)
        shared = "".join(rng.choice("abcdefgh") for _ in range(k + w - 1))
        a, b = found([word(30) + shared + word(20), word(11) + shared.upper() + word(40)], k, w)
        assert {h for h, _ in a} & {h for h, _ in b}


def test_every_row_has_a_row(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 300_000), (3, "x" * 300_000), (None, "Some text " * 40)], "doc_id long, text string").withColumn("hashes", F.lit(0)).withColumn("id", F.lit(0)).withColumn("f", F.lit(0))
    rows = W.fingerprints(df).collect()
    assert sorted((r.doc_id or 0, len(r.hashes) > 0) for r in rows) == [(0, True), (1, False), (2, False), (3, True), (3, True)]
    assert all(len(r.hashes) == len(r.positions) for r in rows)
    assert W.fingerprints(df.limit(0)).count() == 0
