"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is a logistic function of
the words in it; a document's is the noisy-or of its sentences' scores,
``1 - prod(1 - p)``.  Only documents are labelled: the weights are fitted by
proximal gradient descent on the document likelihood, with an L1 penalty, and the
sentence scores then tell which sentences made a document toxic.

Scale: fitting sees a bounded sample of labelled documents (`TRAIN_DOCS`, a
parameter), so the model has a bounded size and ships with the closure; scoring is
one map over all documents without a shuffle.

Defined results: a null or blank text scores null and is never toxic; without a
positive and a negative label nothing is; a document labelled twice counts as
toxic if any label says so; labels without a document, and null labels, are
ignored; a document in two rows is scored in each.  Columns besides the named ones
are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need
from .simhash import RADIUS, Forest, fingerprints
from .textops import Words, char_index, chunks, flat, fold, lists, mix

#: Bound of the labelled sample that the model is fitted on.
TRAIN_DOCS = 8_000
#: Features are screened before fitting: in so many toxic documents at least, and so many times as frequent there as in others.
MIN_TOXIC, MIN_RATIO = 4, 3.0
#: Lengths, in bytes, of the words' beginnings that are features.
PREFIXES = (3, 4, 5, 6, 7)

_SCORE = "struct<score:double,sentences:array<struct<start:int,stop:int,score:double>>>"


def sentence_ends(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Offsets just after each sentence: after . ! ? that white space follows, after a line and after 。, and at documents' ends."""
    n = len(buf)
    if not n:
        return off[1:]
    nxt = np.empty(n, np.uint8)
    nxt[:-1], nxt[-1] = buf[1:], 32
    space = (nxt == 32) | ((nxt >= 9) & (nxt <= 13))
    end = (((buf == 46) | (buf == 33) | (buf == 63)) & space) | (buf == 10)
    if n > 2:
        tri = np.flatnonzero((buf[:-2] == 0xE3) & (buf[1:-1] == 0x80) & (buf[2:] == 0x82))
        end[tri + 2] = True
    return np.union1d(np.flatnonzero(end) + 1, off[1:])


@dataclass
class Model:
    """Words' hashes, sorted, with their weights; the others weigh nothing."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -50.0
    threshold: float = 0.5
    #: F1 on the part of the sample that fitting didn't see.
    held_out: float = float("nan")

    def used(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the features that weigh something, and their weights."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0)
        top = np.zeros(1 << 16, bool)
        top[(self.keys >> np.uint64(48)).astype(np.int64)] = True
        maybe = np.flatnonzero(top[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == h[maybe]
        return maybe[hit], self.weights[at[hit]]


def _instances(buf, off):
    """(sentence ends, hash and sentence of each feature, words in each sentence)

    A word's features are itself and, for languages that build words from parts, its first 3 to 7 bytes.
    """
    folded = fold(buf)
    words = Words(buf, off, folded=folded)
    ends = sentence_ends(buf, off)
    sentence = np.searchsorted(ends, words.starts, "right")
    long = words.ends - words.starts
    h, s = [words.hash], [sentence]
    for n in PREFIXES:
        i = np.flatnonzero(long > n)
        head = mix(np.zeros(len(i), np.uint64) + np.uint64(n))
        for k in range(n):
            head = head * np.uint64(0x100000001B3) ^ folded[words.starts[i] + k]
        h.append(mix(head))
        s.append(sentence[i])
    return ends, np.concatenate(h), np.concatenate(s), np.bincount(sentence, minlength=len(ends))


def _first_in_sentence(sentence: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Indices of each word's first use in its sentence."""
    order = np.lexsort((h, sentence))
    s, x = sentence[order], h[order]
    keep = np.ones(len(order), bool)
    keep[1:] = (s[1:] != s[:-1]) | (x[1:] != x[:-1])
    return order[keep]


def score_chunk(model: Model, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: documents' scores, and ends, scores and documents of its sentences."""
    ends, h, sentence, n_words = _instances(buf, off)
    used, weight = model.used(h)
    once = _first_in_sentence(sentence[used], h[used])
    z = np.bincount(sentence[used[once]], weight[once], len(ends)) + model.bias
    p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    p = np.where(n_words > 0, p, 0.0)
    doc = np.searchsorted(off[1:], ends, "left")
    doc = np.minimum(doc, len(off) - 2)
    total = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(off) - 1)
    return -np.expm1(total), ends, p, doc


def _scorer(model: Model, sentences: bool):
    def score(text: pa.Array) -> pa.Array:
        buf, off = flat(text)
        blank = np.ones(len(off) - 1, bool)
        scores, kept = np.zeros(len(off) - 1), []
        for a, b in chunks(off):
            part, local = buf[off[a] : off[b]], off[a : b + 1] - off[a]
            s, ends, p, doc = score_chunk(model, part, local)
            scores[a:b] = s
            blank[a:b] = np.bincount(doc, p, b - a) == 0
            if sentences:
                hit = np.flatnonzero((p >= model.threshold) & (s[doc] >= model.threshold))
                # a document whose sentences are each below the threshold is shown by its strongest
                top = np.zeros(b - a)
                np.maximum.at(top, doc, p)
                weak = np.flatnonzero((s[doc] >= model.threshold) & (top[doc] < model.threshold) & (p == top[doc]))
                hit = np.union1d(hit, weak)
                if len(hit):
                    chars = char_index(part, local)
                    lo = np.where(hit > 0, ends[np.maximum(hit, 1) - 1], 0)
                    lo = np.maximum(lo, local[doc[hit]])
                    base = chars[local[doc[hit]]]
                    kept.append((doc[hit] + a, chars[lo] - base, chars[ends[hit]] - base, p[hit]))
        null = pa.array(scores, mask=blank)
        if not sentences:
            return null
        cols = [np.concatenate(c) for c in zip(*kept)] if kept else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        each = pa.StructArray.from_arrays([pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3])], ["start", "stop", "score"])
        return pa.StructArray.from_arrays([null, lists(each, np.bincount(cols[0], minlength=len(scores)))], ["score", "sentences"])

    return score


def fit_arrays(feature: np.ndarray, sentence: np.ndarray, doc_of: np.ndarray, y: np.ndarray, start: np.ndarray, *, rounds: int = 400, l1: float = 2e-5, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and bias by proximal AdaGrad on the noisy-or likelihood of the documents, from the weights in `start`."""
    n = len(y)
    per_doc = max(1.0, len(doc_of) / max(1, n))
    w, bias = start.copy(), -np.log(10 * per_doc)
    seen_w, seen_b = np.full(len(w), 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(sentence, w[feature], len(doc_of)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        big = np.maximum(-np.expm1(np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), n)), 1e-9)
        slope = np.where(y > 0, -(1 - big) / big, 1.0)[doc_of] * p
        gw, gb = np.bincount(feature, slope[sentence], len(w)) / n, slope.sum() / n
        seen_w += gw * gw
        seen_b += gb * gb
        step = rate / np.sqrt(seen_w)
        w -= step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        bias -= rate / np.sqrt(seen_b) * gb
    return w, float(bias)


def _screen(parts, y: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features that are in at least MIN_TOXIC toxic documents and MIN_RATIO times as frequent there as elsewhere, and the logarithms of those ratios."""
    total: dict[bool, list] = {True: [], False: []}
    for h, doc in parts:
        for toxic in (True, False):
            sel = ((y[doc] > 0) == toxic) & used[doc]
            pair = np.unique(np.stack([h[sel], doc[sel].astype(np.uint64)], 1), axis=0)
            total[toxic].append(np.unique(pair[:, 0], return_counts=True))

    def merged(found):
        keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([c for _, c in found]), len(keys))

    keys, pos = merged(total[True])
    keys, pos = keys[pos >= MIN_TOXIC], pos[pos >= MIN_TOXIC]
    other, neg = merged(total[False])
    at = np.minimum(np.searchsorted(other, keys), max(0, len(other) - 1))
    neg = np.where(other[at] == keys, neg[at], 0) if len(other) else np.zeros(len(keys))
    n_pos, n_neg = (y[used] > 0).sum(), (y[used] == 0).sum()
    ratio = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    keep = ratio >= np.log(MIN_RATIO)
    return keys[keep], ratio[keep]


def _no_copies(text) -> np.ndarray:
    """The documents that aren't near copies of an earlier one: the words of a text with many copies would all seem telling."""
    buf, off = flat(text)
    prints = [fingerprints(buf[off[a] : off[b]], off[a : b + 1] - off[a])[0] for a, b in chunks(off)]
    later, _ = Forest(np.concatenate(prints), np.zeros(len(off) - 1, np.int64)).pairs(RADIUS)
    return np.setdiff1d(np.arange(len(off) - 1), later)


def _fit_table(table: pa.Table) -> Model:
    """The model of a table of (toxic, text)."""
    table = table.take(pa.array(_no_copies(table["text"])))
    y = np.array(table["toxic"].to_pylist(), int)
    buf, off = flat(table["text"])
    held = np.arange(len(y)) % 4 == 3
    if not (0 < y[~held].sum() < (~held).sum()):
        return Model()

    def parts():
        for a, b in chunks(off):
            part, local = buf[off[a] : off[b]], off[a : b + 1] - off[a]
            ends, h, sentence, _ = _instances(part, local)
            yield h, sentence, np.minimum(np.searchsorted(local[1:], ends, "left"), b - a - 1) + a

    keys, ratio = _screen(((h, doc[sentence]) for h, sentence, doc in parts()), y, ~held)
    if not len(keys):
        return Model()
    known = Model(keys, np.arange(1.0, len(keys) + 1))
    feature, sentences, doc_of, base = [], [], [], 0
    for h, sentence, doc in parts():
        i, slot = known.used(h)
        once = _first_in_sentence(sentence[i], h[i])
        feature.append(slot[once].astype(np.int64) - 1)
        sentences.append(sentence[i[once]] + base)
        doc_of.append(doc)
        base += len(doc)
    feature, sentence, doc_of = np.concatenate(feature), np.concatenate(sentences), np.concatenate(doc_of)
    used, in_train = ~held[doc_of[sentence]], ~held[doc_of]
    w, bias = fit_arrays(feature[used], (np.cumsum(in_train) - 1)[sentence[used]], (np.cumsum(~held) - 1)[doc_of[in_train]], y[~held], ratio / 2)
    model = Model(keys[w != 0], w[w != 0], bias)
    scores = np.concatenate([score_chunk(model, buf[off[a] : off[b]], off[a : b + 1] - off[a])[0] for a, b in chunks(off)])
    judged = held if 0 < y[held].sum() < held.sum() else ~held
    order = np.argsort(-scores[judged])
    s, hits = scores[judged][order], np.cumsum(y[judged][order])
    n, found = np.arange(1, len(s) + 1), y[judged].sum()
    f = 2 * hits / (found + n)
    ends_run = np.append(s[:-1] > s[1:], True)
    best = int(np.argmax(np.where(ends_run, f, -1)))
    below = s[best + 1] if best + 1 < len(s) else 0.0
    # between two scores, but where neither many words that mean nothing nor one that means all decides
    model.threshold = float(np.clip((s[best] + below) / 2, 0.3, 0.7))
    model.held_out = float(f[best])
    return model


def fit(documents: DataFrame, labels: DataFrame, *, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most `train_docs` labelled documents, chosen by a hash of their ids, fitted in one task."""
    known = need(labels, id_col, label_col).toDF("id", "toxic").where("id is not null and toxic is not null")
    known = known.groupBy("id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = known.orderBy(F.xxhash64("id", F.lit(8)), "id").limit(train_docs)
    docs = need(documents, id_col, text_col).toDF("id", "text").where("id is not null and text is not null")
    # at most train_docs pairs of numbers, so of a bounded size
    bag = docs.join(F.broadcast(sample), "id").withColumn("one", F.lit(1))

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        m = _fit_table(table)
        return pa.table({"keys": [m.keys.tobytes()], "weights": [m.weights.tobytes()], "bias": [m.bias], "threshold": [m.threshold], "held_out": [m.held_out]})

    rows = bag.groupBy("one").applyInArrow(train, "keys binary, weights binary, bias double, threshold double, held_out double").collect()
    if not rows:
        return Model()
    r = rows[0]
    return Model(np.frombuffer(bytes(r.keys), np.uint64), np.frombuffer(bytes(r.weights), np.float64), r.bias, r.threshold, r.held_out)


def score(model: Model, text: str | Column) -> Column:
    """The documents' noisy-or score; null for a text without a word."""
    return F.arrow_udf(_scorer(model, False), "double")(text)


def toxic_documents(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, sentences) of each document at or above the model's threshold.

    `sentences` has start and stop, in characters, and score of each sentence at or above it, or of the strongest one.
    """
    found = F.arrow_udf(_scorer(model, True), _SCORE)("text")
    docs = need(documents, id_col, text_col).toDF("id", "text").where("text is not null")
    return docs.select("id", found.alias("s")).where(F.col("s.score") >= model.threshold).select(F.col("id").alias(id_col), "s.score", "s.sentences")


def drop_toxic(documents: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The documents without the toxic ones; columns and blank documents stay."""
    s = score(model, documents[text_col])
    return documents.where(~F.coalesce(s >= F.lit(model.threshold), F.lit(False)))
