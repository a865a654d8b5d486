import random
from collections import defaultdict

from pyspark.sql import functions as F

from quillet.llm import sparse_suffix as S


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    rng = random.Random(4)
    docs = {i: words(rng, rng.choice([10, 60, 200, 400])) for i in range(60)}
    passages = [words(rng, n) for n in (50, 51, 75, 120, 300)]
    for p in passages:
        for i in rng.sample(range(60), 6):
            at = rng.randrange(len(docs[i]) + 1)
            docs[i] = docs[i][:at] + p + docs[i][at:]
    docs[60] = list(docs[3])
    docs[61] = words(rng, 20) + docs[5][:49] + words(rng, 20)
    docs[62] = ["same"] * 300
    docs[63] = ["x"] + ["same"] * 120 + ["y"]
    return docs


def brute(docs, n):
    """Pairs of documents that share n words in a row."""
    where = defaultdict(set)
    for d, w in docs.items():
        for i in range(len(w) - n + 1):
            where[tuple(w[i : i + n])].add(d)
    return {(a, b) for s in where.values() for a in s for b in s if a < b}


def connected(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    return root


def test_like_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    rows = S.repeated_passages(df).collect()
    want = brute(docs, 50)
    got = {(r.doc_a, r.doc_b) for r in rows}
    assert got <= want
    for r in rows:
        a, b = docs[r.doc_a], docs[r.doc_b]
        assert r.n_words >= 50
        assert a[r.start_a : r.start_a + r.n_words] == b[r.start_b : r.start_b + r.n_words]
        if r.doc_a < 62:
            assert r.start_a == 0 or r.start_b == 0 or a[r.start_a - 1] != b[r.start_b - 1]
            ea, eb = r.start_a + r.n_words, r.start_b + r.n_words
            assert ea == len(a) or eb == len(b) or a[ea] != b[eb]
    root = connected(got)
    assert all(root(a) == root(b) for a, b in want)
    # whatever a document shares with another is covered
    shared = defaultdict(set)
    where = defaultdict(set)
    for d, w in docs.items():
        for i in range(len(w) - 49):
            where[tuple(w[i : i + 50])].add((d, i))
    for s in where.values():
        if len({d for d, _ in s}) > 1:
            for d, i in s:
                shared[d] |= set(range(i, i + 50))
    covered = defaultdict(set)
    for r in rows:
        covered[r.doc_a] |= set(range(r.start_a, r.start_a + r.n_words))
        covered[r.doc_b] |= set(range(r.start_b, r.start_b + r.n_words))
    total = sum(len(v) for d, v in shared.items() if d < 62)
    assert sum(len(v & covered[d]) for d, v in shared.items() if d < 62) >= 0.99 * total


def test_many_holders_give_a_chain(spark):
    rng = random.Random(8)
    passage = words(rng, 80)
    docs = {i: words(rng, 30) + passage + words(rng, 30) for i in range(300)}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    rows = S.repeated_passages(df).collect()
    assert {d for r in rows for d in (r.doc_a, r.doc_b)} == set(docs)
    root = connected([(r.doc_a, r.doc_b) for r in rows])
    assert len({root(d) for d in docs}) == 1
    assert len(rows) < 30 * len(docs)


def test_edges(spark):
    rng = random.Random(1)
    long = " ".join(words(rng, 60_000, 9999))
    p = " ".join(words(rng, 70))
    rows = [(1, None), (2, ""), (3, "a b c"), (4, long), (5, "x " + long), (6, p), (6, p), (None, p), (7, "q " + p), (7, p + " r")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit(1)).withColumn("id", F.lit("a")).withColumn("pos", F.lit(1))
    got = {(r.doc_a, r.doc_b): r.n_words for r in S.repeated_passages(df).collect()}
    assert got[(4, 5)] == 60_000
    assert set(got) <= {(4, 5), (6, 7), (7, 7)} and len(got) >= 2
    assert S.repeated_passages(df.limit(0)).count() == 0


def linked(rows):
    root = connected([(r.doc_a, r.doc_b) for r in rows])
    return lambda docs: len({root(d) for d in docs}) == 1


def test_a_crowded_line_hides_no_passage(spark):
    """Few of many documents with a line share more around it, on either side or on both; crowds share one side alone."""
    docs = {}
    for case in range(12):
        rng = random.Random(100 + case)
        line, before, after = words(rng, 30), words(rng, 24), words(rng, 24)
        for i in range(40):
            docs[1000 * case + i] = words(rng, 40) + line + words(rng, 40)
        for i in range(40, 80):  # 19 words of one side
            docs[1000 * case + i] = words(rng, 40) + before[5:] + line + words(rng, 40) if i % 2 else words(rng, 40) + line + after[:19] + words(rng, 40)
        left = 2 * case
        for i in (7, 33, 61, 74):
            docs[1000 * case + i] = words(rng, 40) + before[24 - left :] + line + after[: 22 - left] + words(rng, 40)
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    rows = S.repeated_passages(df).collect()
    want = brute(docs, 50)
    assert {(r.doc_a, r.doc_b) for r in rows} <= want
    root = connected([(r.doc_a, r.doc_b) for r in rows])
    assert all(root(a) == root(b) for a, b in want) and len(want) >= 12 * 6


def test_groups_that_are_too_large_for_memory(spark):
    docs = S._documents(spark.createDataFrame([(d, " ".join(w)) for d, w in corpus().items()], "doc_id long, text string"), "doc_id", "text")
    table = S.suffix_table(docs, S.K, S.MIN_WORDS - S.K + 1)
    runs = lambda **k: {tuple(r) for r in S.runs_of(S.neighbour_pairs(table, S.MIN_WORDS, **k)).collect()}
    want = runs()
    assert runs(group=2) == runs(group=1) == want and len(want) > 20


def test_a_passage_in_all_documents_is_cut_into_pieces(spark):
    """More holders than a partition: the pieces are chained, by as many pairs."""
    rng = random.Random(15)
    passage = words(rng, 60)
    df = spark.createDataFrame([(d, " ".join([f"a{d}", *passage, f"b{d}"])) for d in range(500)], "doc_id long, text string")
    table = S.suffix_table(S._documents(df, "doc_id", "text"), S.K, S.MIN_WORDS - S.K + 1)
    runs = S.runs_of(S.neighbour_pairs(table, S.MIN_WORDS, group=64)).collect()
    root = connected([(r.a, r.b) for r in runs])
    assert len({root(x) for r in runs for x in (r.a, r.b)}) == 1 and len({(r.a, r.b) for r in runs}) == 499


def test_borders_are_exact(spark):
    """Words whose hashes have the same top 16 bits differ all the same."""
    rng = random.Random(21)
    p = words(rng, 80)
    hash_ = lambda w: int(S.Words(*S.flat(S.pa.array([w]))).hash[0]) >> 48
    seen, twins = {}, None
    for i in range(5000):
        if twins is None and hash_(f"q{i}") in seen:
            twins = seen[hash_(f"q{i}")], f"q{i}"
        seen.setdefault(hash_(f"q{i}"), f"q{i}")
    docs = {}
    for n, (x, y) in enumerate([("q7", "q74"), twins]):
        docs[10 * n] = [*words(rng, 30), x, *p[40 * n :], *p[: 40 * n], x, *words(rng, 30)]
        docs[10 * n + 1] = [*words(rng, 30), y, *p[40 * n :], *p[: 40 * n], y, *words(rng, 30)]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    rows = S.repeated_passages(df).collect()
    assert sorted((r.doc_a, r.doc_b, r.start_a, r.start_b, r.n_words) for r in rows) == [(0, 1, 31, 31, 80), (10, 11, 31, 31, 80)]
    sides = {tuple(r) for r in S.by_document(S.repeated_passages(df)).collect()}
    assert sides == {(a, 31, 80, b, 31) for a, b in ((0, 1), (1, 0), (10, 11), (11, 10))}
    assert S.by_document(S.repeated_passages(df)).columns == ["doc_id", "start", "n_words", "other_id", "other_start"]


def test_a_repeat_within_a_document_hides_no_passage(spark):
    """A notice early on and again inside the passage that two documents share."""
    docs = {}
    for case in range(12):
        rng = random.Random(300 + case)
        notice, passage = words(rng, 40), words(rng, 12)
        passage = passage[: case + 1] + notice + passage[case + 1 :]
        docs[2 * case] = words(rng, 20) + notice + words(rng, 60) + passage + words(rng, 20)
        docs[2 * case + 1] = words(rng, 30) + passage + words(rng, 30)
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    got = {(r.doc_a, r.doc_b): r.n_words for r in S.repeated_passages(df).collect()}
    assert got == {(2 * case, 2 * case + 1): 52 for case in range(12)}
