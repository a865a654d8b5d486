import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillet.llm import simhash as S
from quillet.llm import textops as T


def naive_components(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def test_fingerprint_is_the_majority_of_distinct_words():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(700)]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 3, 40, 900]))) for _ in range(30)] + ["", "a a a b"]
    buf, off = T.flat(pa.array(texts))
    fp, count = S.fingerprints(buf, off)
    w = T.Words(buf, off)
    for d in range(len(texts)):
        h = np.unique(w.hash[w.first[d] : w.first[d + 1]])
        assert count[d] == len(h)
        bits = np.unpackbits(np.stack([h, T.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))], 1).view(np.uint8).reshape(len(h), -1), axis=1) if len(h) else np.zeros((0, 128))
        assert (np.unpackbits(fp[d : d + 1].view(np.uint8)) == (2 * bits.sum(0) > len(h))).all()


def test_forest_search_is_exact():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, (40, 2), dtype=np.uint64)
    points = np.repeat(base, 12, 0) ^ np.where(rng.random((480, 2)) < 0.7, np.uint64(1) << rng.integers(0, 64, (480, 2)).astype(np.uint64), np.uint64(0))
    shard = np.sort(rng.integers(0, 9, 480))
    for r in (0, 3, 20, 64, 128):
        i, j = S.Forest(points, shard).pairs(r, block=50)
        want = {(a, b) for a in range(480) for b in range(a) if shard[a] == shard[b] and S.distance(points[a], points[b]) <= r}
        assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_recall_and_precision_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").union(spark.read.parquet(f"{small}/../sf0.01/documents.parquet").selectExpr("doc_id + 10000", "text", "lang", "source", "n_chars"))
    nodes = S.fingerprint_table(docs).groupBy("hi", "lo").agg(F.min("id").alias("rep")).collect()
    points = np.array([[r.hi, r.lo] for r in nodes], np.int64).view(np.uint64)
    ids = [r.rep for r in nodes]
    want = set()
    for i in range(len(ids)):
        near = np.flatnonzero(S.distance(points[i + 1 :], points[i]) <= S.RADIUS) + i + 1
        want |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in near}
    df = spark.createDataFrame([(r.rep, r.hi, r.lo) for r in nodes], "rep long, hi long, lo long")
    rows = S.near_pairs(df, S.RADIUS, len(ids), S.RECALL).collect()
    got = {(r.a, r.b) for r in rows}
    assert got <= want and len(got) == len(rows)
    assert len(got) >= 0.9 * len(want) > 0
    # also of the farthest ones
    place = {x: i for i, x in enumerate(ids)}
    far = {(a, b) for a, b in want if S.distance(points[place[a]], points[place[b]]) > 15}
    assert len(got & far) >= 0.9 * len(far)


def test_keys_widen_with_the_corpus():
    assert S.layout(10, 20, 0.9)[0] == 16 and S.layout(1 << 30, 20, 0.9)[0] == 22
    assert S.key_places(22, 30).shape == (30, 22)
    b, t = S.layout(1 << 30, 20, 0.9)
    assert 1 - (1 - (1 - 15 / 128) ** b) ** t >= 0.9
    for n in (10, 1 << 24, 1 << 30, 1 << 35):
        b, t = S.layout(n, 20, 0.9)
        assert 1 - (1 - (1 - 20 / 128) ** b) ** t >= 0.9 and t < 1 << 16 and b <= 46


def test_more_tables_than_a_byte_can_number(spark):
    """A wide radius with a high recall takes hundreds of keys; each pair is still found, once."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, (30, 2), dtype=np.uint64)
    points = np.concatenate([base, base ^ np.uint64(0x0101010101010101)])
    assert S.layout(60, 40, 0.95)[1] > 255
    df = spark.createDataFrame([(i, int(hi), int(lo)) for i, (hi, lo) in enumerate(points.view(np.int64))], "rep long, hi long, lo long")
    got = sorted((r.a, r.b) for r in S.near_pairs(df, 40, 60, 0.95).collect())
    want = [(i, j) for i in range(60) for j in range(i + 1, 60) if S.distance(points[i], points[j]) <= 40]
    assert got == want and len(want) >= 30


@pytest.mark.parametrize("seed", [0, 1])
def test_components_like_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(17)] + [(5, 5)]
    want = naive_components([p for p in pairs if p[0] != p[1]])
    got = {r.node: r.root for r in S.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {k: v for k, v in got.items() if k != v} == {k: v for k, v in want.items() if k != v}
    assert S.components(spark.createDataFrame([], "a long, b long")).count() == 0


def text(seed, n=200):
    rng = random.Random(seed)
    return [f"word{rng.randrange(5000)}" for _ in range(n)]


def documents(spark):
    rows, rng = [], random.Random(9)
    for g in range(12):
        base = text(g)
        rows.append((10 * g, " ".join(base)))
        for k in range(1, 4):
            near = list(base)
            for _ in range(4):
                near[rng.randrange(len(near))] = f"new{rng.randrange(999)}"
            rows.append((10 * g + k, " ".join(near)))
    rows += [(1000 + i, " ".join(text(500 + i))) for i in range(30)]
    rows += [(2000, None), (2001, ""), (2002, "!!"), (None, " ".join(text(0))), (0, " ".join(text(0))), (3000, "long " + "tale " * 200_000), (3001, "long tale"), (20, " ".join(text(777)))]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep", F.lit(1)).withColumn("id", F.lit("x")).withColumn("n_chars", F.length("text"))


def test_groups_and_drop(spark):
    docs = documents(spark)
    groups = defaultdict(set)
    for r in S.groups(docs).collect():
        groups[r.keep_id].add(r.doc_id)
    assert {k: v for k, v in groups.items() if k < 1000} == {10 * g: {10 * g, 10 * g + 1, 10 * g + 2, 10 * g + 3} for g in range(12)}
    assert groups[3000] == {3000, 3001}
    left = S.drop_copies(docs)
    assert left.columns == docs.columns
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in left.collect())
    # the repeated row of 0 goes; both texts of 20 stay
    assert ids == sorted([-1, *(10 * g for g in range(12)), 20, *(1000 + i for i in range(30)), 2000, 2001, 2002, 3000])


def test_empty_table(spark):
    docs = documents(spark).limit(0)
    assert S.groups(docs).count() == 0 and S.drop_copies(docs).count() == 0


def test_an_id_of_several_texts_loses_the_copies_alone(spark):
    a, b, c = (" ".join(text(s)) for s in (1, 2, 3))
    near = a.replace(a.split()[5], "changed")
    rows = [(20, a, 1), (21, near, 2), (21, b, 3), (22, b, 4), (22, b, 5), (23, None, 6), (23, c, 7), (24, c, 8), (24, "", 9), (25, a + " x", 10), (25, a, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").withColumns({c: F.lit(0) for c in ("__gone", "__id", "gone", "hi", "fp", "row", "place")})
    left = S.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.n for r in left.collect()) == [1, 3, 6, 7, 9]
    found = {(r.doc_id, r.keep_id) for r in S.groups(docs).collect()}
    assert found == {(20, 20), (21, 20), (25, 20), (21, 21), (22, 21), (23, 23), (24, 23)}
    # one id alone with near copies is a group, of which one text stays
    own = spark.createDataFrame([(1, a), (1, near), (2, b)], "doc_id long, text string")
    assert [tuple(r)[:2] for r in S.groups(own).collect()] == [(1, 1)] and S.drop_copies(own).count() == 2


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_of_distinct_ids_are_not_shuffled(spark):
    a, b = (" ".join(text(s)) for s in (1, 2))
    near = a.replace(a.split()[5], "changed")
    rows = [(1, a, 1), (2, near, 2), (3, b, 3), (None, a, 4), (5, None, 5), (6, "", 6), (7, b, 7)]
    for kind in ("long", "string", "decimal(20,0)"):
        docs = spark.createDataFrame(rows, "doc_id long, text string, n long").withColumn("doc_id", F.col("doc_id").cast(kind))
        left = S.drop_copies(docs)
        assert "Exchange" not in plan(left) and "Join" not in plan(left)
        assert left.schema == docs.schema and sorted(r.n for r in left.collect()) == [1, 3, 4, 5, 6]


def test_ids_of_one_key_are_told_apart(spark, monkeypatch):
    a, b = (" ".join(text(s)) for s in (1, 2))
    rows = [(1, a, 1), (2, a, 2), (3, b, 3), (4, None, 4), (None, a, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    monkeypatch.setattr(S.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    assert sorted(r.n for r in S.drop_copies(docs).collect()) == [1, 3, 4, 5]


def test_rows_of_all_shards_are_made_by_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    nodes = spark.createDataFrame([(i, int(h), int(l)) for i, (h, l) in enumerate(rng.integers(-(2**63), 2**63, (1000, 2)))], "rep long, hi long, lo long").coalesce(1)
    monkeypatch.setattr(S, "SPREAD_ROWS", 5000)
    # 34 keys of 1000 rows
    assert "RoundRobinPartitioning(7)" in plan(S.near_pairs(nodes, 20, 1000, 0.9))


def dense(n, far, seed):
    """Fingerprints of a dense group of n, and of `far` others, in any order."""
    rng = np.random.default_rng(seed)
    near = rng.integers(0, 2**63, 2, dtype=np.uint64) ^ np.packbits(rng.random((n, 128)) < 0.05, axis=1).view(np.uint64)
    return rng.permutation(np.concatenate([near, rng.integers(0, 2**63, (far, 2), dtype=np.uint64)]))


def test_links_have_the_components_of_all_pairs():
    rng = np.random.default_rng(6)
    # groups of every density up to chains of pairs just within the radius
    parts = [dense(150, 60, 1), dense(40, 0, 2)]
    for share in (0.05, 0.08, 0.09, 0.1):
        parts.append(parts[0][0] ^ np.packbits(rng.random((80, 128)) < share, axis=1).view(np.uint64))
    points = rng.permutation(np.concatenate(parts))
    shard = np.sort(rng.integers(0, 3, len(points)))
    for r in (0, 3, 14, 17, 20, 64, 128):
        f = S.Forest(points, shard)
        i, j = f.pairs(r)
        want = naive_components(zip(i.tolist(), j.tolist()))
        for block in (7, 1 << 15):
            pieces = list(f.links(r, block))
            a, b = (np.concatenate(x) for x in zip(*pieces))
            assert (S.distance(points[a], points[b]) <= r).all() and (shard[a] == shard[b]).all()
            got = naive_components(zip(a.tolist(), b.tolist()))
            assert got == want and len(a) == len(want) - len(set(want.values()))
    assert sum(len(a) for a, _ in S.Forest(points[:0], shard[:0]).links(20)) == 0


def test_a_dense_group_is_searched_in_little_memory():
    import tracemalloc

    points = dense(2500, 500, 3)
    f = S.Forest(points, np.zeros(len(points), np.int64))
    tracemalloc.start()
    links = sum(len(i) for i, _ in f.links(20, 4096))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    pairs = sum(len(i) for i, _ in f.near(20, 4096))
    assert max(peak, tracemalloc.get_traced_memory()[1]) < 20e6 < 16 * pairs
    tracemalloc.stop()
    assert links < len(points)


def test_groups_write_no_square_of_a_dense_group(spark, monkeypatch):
    """Of a thousand different near copies, half a million pairs, a table keeps what joins them."""
    base = text(1)
    docs = spark.createDataFrame([(i, " ".join([*base, f"new{i}", f"more{i}", f"{i}th"])) for i in range(1000)], "doc_id long, text string")
    rows = {}

    def written(df, tag, write=S.written):
        table = write(df, tag)
        rows[tag] = max(rows.get(tag, 0), table.count())
        return table

    monkeypatch.setattr(S, "written", written)
    assert [tuple(r) for r in S.groups(docs).groupBy("keep_id").count().collect()] == [(0, 1000)]
    assert 500 < rows["nodes"] <= 1000 and rows["pairs"] < rows["nodes"] * S.layout(1000, 20, 0.9)[1]
