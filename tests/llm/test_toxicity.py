import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillet.llm import textops as T
from quillet.llm import toxicity as X


def corpus(n=600, seed=2):
    rng, rows, labels, bad = random.Random(seed), [], [], {}
    for i in range(n):
        sentences = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(4, 12))) + "." for _ in range(rng.randrange(1, 9))]
        toxic = rng.random() < 0.3
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] = sentences[k][:-1] + " " + rng.choice(["scum", "idiot"]) + "."
            bad[i] = k
        rows.append((i, " ".join(sentences)))
        labels.append((i, int(toxic)))
    return rows, labels, bad


def test_sentences():
    buf, off = T.flat(pa.array(["A b. C 3.5 d! E\nf", "", "g。h"]))
    ends = X.sentence_ends(buf, off).tolist()
    texts, last = [], 0
    for e in ends:
        texts.append(buf[last:e].tobytes().decode())
        last = e
    assert [t.strip() for t in texts if t.strip()] == ["A b.", "C 3.5 d!", "E", "f", "g。", "h"]


def test_scores_like_a_loop():
    rng = random.Random(1)
    buf, off = T.flat(pa.array(["alpha beta. beta gamma! ", "", "...", "alpha alpha delta"]))
    h = lambda w: T.Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)])).hash[0]
    weights = {w: rng.uniform(-2, 3) for w in ("alpha", "beta", "gamma")}
    keys = np.array([h(w) for w in weights], np.uint64)
    order = np.argsort(keys)
    m = X.Model(keys[order], np.array(list(weights.values()))[order], bias=-1.0)
    scores = X.score_chunk(m, buf, off)[0]
    p = lambda ws: 1 / (1 + np.exp(-(sum(weights.get(w, 0) for w in set(ws)) - 1)))
    want = [1 - (1 - p(["alpha", "beta"])) * (1 - p(["beta", "gamma"])), 0, 0, p(["alpha", "delta"])]
    assert np.allclose(scores, want)


def test_held_out_accuracy_and_sentences(spark):
    rows, labels, bad = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([r for r in labels if r[0] < 400] + [(None, 1), (3, None), (10**6, 1)], "doc_id long, toxic int")
    m = X.fit(docs, known)
    found = {r.doc_id: r for r in X.toxic_documents(docs, m).collect()}
    truth = {i for i, t in labels if t}
    unseen = set(range(400, 600))
    assert len(truth & unseen & set(found)) >= 0.95 * len(truth & unseen)
    assert len(set(found) - truth) <= 3
    texts = dict(rows)
    hit = sum(any("scum" in texts[i][s.start : s.stop] or "idiot" in texts[i][s.start : s.stop] for s in r.sentences) for i, r in found.items() if i in truth)
    assert hit >= 0.95 * len(truth & set(found))


def test_accuracy_on_the_tables(spark, small):
    d = small.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train, test = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    found = {r.doc_id for r in X.toxic_documents(docs, X.fit(docs, train)).select("doc_id").collect()}
    rows = test.collect()
    toxic = {r.doc_id for r in rows if r.toxic}
    assert len(toxic & found) >= 0.85 * len(toxic)
    assert len([r for r in rows if not r.toxic and r.doc_id in found]) <= 0.005 * len(rows)


def test_edges(spark):
    rows, labels, _ = corpus(200)
    rows += [(900, None), (901, ""), (902, "?!"), (None, "scum idiot scum"), (903, "w1 " * 100_000 + "scum."), (rows[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("sentences", F.lit(1)).withColumn("id", F.lit(1))
    known = spark.createDataFrame(labels + labels[:5], "doc_id long, toxic int")
    m = X.fit(docs, known)
    left = X.drop_toxic(docs, m)
    assert left.columns == docs.columns
    ids = {r.doc_id for r in left.collect()}
    assert {900, 901, 902} <= ids and None not in ids
    assert left.count() + X.toxic_documents(docs, m).count() == docs.count()
    # without labels of both kinds nothing is toxic
    for k in (known.limit(0), known.where("toxic = 1"), known.where("toxic = 0")):
        assert X.toxic_documents(docs, X.fit(docs, k)).count() == 0
    assert X.drop_toxic(docs.limit(0), m).count() == 0
    assert X.fit(docs.limit(0), known).bias == -50.0
