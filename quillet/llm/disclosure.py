"""PII removal by information-theoretic sanitisation.

Protected entities (e-mail addresses, telephone, card, account and social security
numbers, network addresses, keys and tokens) are replaced by their class.  How much
another term t of a document tells about an entity e that the document holds is
estimated from the whole corpus: PMI(t; e) / IC(e), the share of the entity's
information -log p(e) that t discloses, with p by document counts.  Terms that
disclose at least `generalise` become their class ([NUMBER], [NAME], [TERM]), those
that disclose at least `remove` go.

Every entity is estimated.  A pair found in `min_support` distinct texts takes the estimate as it is; of a
rarer one counts what its distinct texts show with 95 % confidence (copies of a text show no more than it does):
the lower limit of a Poisson mean takes the place of their number.  Entities themselves always go.

Scale: one map finds the entities (only texts that can hold one are searched) and their
documents' terms; pairs are counted with map-side combining, one row for each distinct text; entities in fewer
than `min_support` texts have equal counts if they are in the same texts, so they are counted together,
and a text full of such entities has one row for each term, not one for each entity and term;
terms are counted in all documents by a map against a memory-mapped digest array; the
sanitising map looks up in another what each entity's terms are, so that its work is linear in the text's
words, entities and stored pairs.  The text itself is never shuffled.

Defined results: null stays null, an empty text stays empty, a text without an entity is
returned unchanged; every row counts, also a repeated one; a term next to several entities meets the
strictest decision.  Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DigestArray, need, signed, written
from .textops import Words, chunks, flat, lists, runs, span_hash

MIN_SUPPORT = 3
GENERALISE = 0.6
REMOVE = 0.85

_RESULT = "struct<text:string,entities:int,generalised:int,removed:int>"

#: The first class that matches at a place wins.
PATTERNS = [
    ("EMAIL", r"[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+"),
    ("SECRET", r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_\w{30,}|sk-[\w\-]{20,}|xox[abp]-[\w\-]{10,}|eyJ[\w\-]{8,}\.[\w\-]{8,}\.[\w\-]+|(?=[\w+/=\-]*[0-9])(?=[\w+/=\-]*[A-Za-z])[\w+/=\-]{32,})"),
    ("IP", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)"),
    ("IP", r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b"),
    ("IBAN", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("SSN", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    ("CARD", r"(?<![\d\-])\d(?:[ \-]?\d){12,18}(?![\d\-])"),
    ("PHONE", r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]?\d{3,4}(?![\d\-])|(?<![\w+])\+\d{7,15}(?!\d)"),
]
_FIND = re.compile("|".join(f"(?P<p{i}>{p})" for i, (_, p) in enumerate(PATTERNS)))


def entity_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, class) of the entities of a text."""
    return [(m.start(), m.end(), PATTERNS[int(m.lastgroup[1:])][0]) for m in _FIND.finditer(text)]


#: What begins a key of few figures or none.  "sk-" counts at a word's beginning alone.
_PREFIXES = (b"AKIA", b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_", b"xoxa-", b"xoxb-", b"xoxp-", b"eyJ", b"sk-")
#: First bytes, in UTF-8, of the characters other than 0-9 that \d matches (and of many others).
_WIDE = np.isin(np.arange(256), [0xD9, 0xDB, 0xDF, 0xE0, 0xE1, 0xEA, 0xEF, *range(0xF0, 0xF5)])
#: Bytes of long tokens: [\w+/=-].
_TOKEN = np.isin(np.arange(256), list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_+/=-")) | (np.arange(256) >= 0x80)


def _candidates(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Documents that can hold an entity: all those of which a pattern matches a part, and some others.

    These hold an @, four figures, a figure that isn't ASCII, a key's prefix, a token of 32 bytes with a figure,
    the beginning of an IBAN, or seven colons as close as those of an address.
    """
    figure = (buf >= 48) & (buf <= 57)
    count = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(figure + np.int64(4) * ((buf == 64) | _WIDE[buf]), out=count[1:])
    found = np.diff(count[off]) >= 4
    places = []
    raw = buf.tobytes()
    for prefix in _PREFIXES:
        at = raw.find(prefix)
        while at >= 0:
            if prefix != b"sk-" or at == 0 or not (raw[at - 1 : at].isalnum() or raw[at - 1] == 95) or bool((off == at).any()):
                places.append(at)
            at = raw.find(prefix, at + 1)
    starts, ends = runs(_TOKEN[buf], off)
    figures = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(figure, out=figures[1:])
    capital = (buf >= 65) & (buf <= 90)
    colon = np.flatnonzero(buf == 58)
    near = colon[:-6][colon[6:] - colon[:-6] <= 30] if len(colon) > 6 else colon[:0]
    iban = np.flatnonzero(capital[:-3] & capital[1:-2] & figure[2:-1] & figure[3:]) if len(buf) > 3 else colon[:0]
    places = np.concatenate([np.array(places, np.int64), starts[(ends - starts >= 32) & (figures[ends] > figures[starts])], near, iban])
    found[np.searchsorted(off, places, "right") - 1] = True
    return np.flatnonzero(found)


def _hash(text: str) -> int:
    raw = np.frombuffer(text.encode(), np.uint8)
    return int(span_hash(raw, np.array([0]), np.array([len(raw)]))[0])


class _Document:
    """The entities and other terms of a text: spans, and hashes of both."""

    def __init__(self, text: str):
        self.text, self.spans = text, entity_spans(text)
        if not self.spans:
            return
        self.entities = np.array([_hash(kind + ":" + re.sub(r"[\s\-().]", "", text[a:b]).lower()) for a, b, kind in self.spans], np.uint64)
        raw = np.frombuffer(text.encode(), np.uint8)
        words = Words(raw, np.array([0, len(raw)]))
        chars = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=chars[1:])
        start, stop = chars[words.starts], chars[words.ends]
        first, last = np.array([x[:2] for x in self.spans]).T  # in order, and apart
        near = np.searchsorted(last, start, "right")  # the first span that ends behind the word's start
        inside = (near < len(first)) & (first[np.minimum(near, len(first) - 1)] < stop)
        self.start, self.stop, self.terms = start[~inside], stop[~inside], words.hash[~inside]


@dataclass
class Disclosures:
    """What the corpus says: a digest array of entities (or texts) and their terms, the lowest bit being the action, or None."""

    pairs: DigestArray | None = None

    def sanitise(self, text: str) -> tuple[str, int, int, int]:
        """(text, entities, generalised terms, removed terms)"""
        d = _Document(text)
        if not d.spans:
            return text, 0, 0, 0
        edits = [(a, b, f"[{kind}]") for a, b, kind in d.spans]
        generalised = removed = 0
        if self.pairs is not None and len(d.terms):
            entities = np.unique(np.append(d.entities, np.uint64(_hash(text))))  # rare entities' terms are stored by text
            told = np.unique(self.pairs.numbers(self.pairs.find(entities)[1]).view(np.uint64))
            told = told[np.append(told[1:] >> np.uint64(1) != told[:-1] >> np.uint64(1), True)] if len(told) else told  # the stricter of two
            at = np.searchsorted(told, d.terms | np.uint64(1), "right") - 1
            known = (at >= 0) & (told[at] >> np.uint64(1) == d.terms >> np.uint64(1)) if len(told) else at >= 0
            action = np.where(known, 1 + (told[at] & np.uint64(1)).astype(int) if len(told) else 0, 0)
            for i in np.flatnonzero(action).tolist():
                a, b = int(d.start[i]), int(d.stop[i])
                word = text[a:b]
                if action[i] == 1:
                    generalised += 1
                    edits.append((a, b, "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[TERM]"))
                else:
                    removed += 1
                    edits.append((a - 1 if a and text[a - 1] == " " else a, b, ""))
        out, at = [], 0
        for a, b, new in sorted(edits):
            out += [text[at : max(a, at)], new]
            at = max(b, at)
        new = "".join(out) + text[at:]
        while removed and (joined := entity_spans(new)):  # by what stood between
            for a, b, kind in reversed(joined):
                new = f"{new[:a]}[{kind}]{new[b:]}"
        return new, len(d.spans), generalised, removed

    def __call__(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The sanitised column, and counts of entities, generalised and removed terms."""
        buf, off = flat(column)
        counts = np.zeros((len(off) - 1, 3), np.int32)
        changed: dict[int, str] = {}
        for i in _candidates(buf, off).tolist():
            new, *n = self.sanitise(buf[off[i] : off[i + 1]].tobytes().decode())
            if n[0]:
                changed[i], counts[i] = new, n
        if not changed:
            return column, counts
        keep = np.ones(len(column), bool)
        keep[list(changed)] = False
        return pc.replace_with_mask(column, pa.array(~keep), pa.array([changed[i] for i in sorted(changed)], column.type)), counts


def _bags(documents: DataFrame, text_col: str) -> DataFrame:
    """(content, entities, terms) of each text that holds an entity."""

    def run(batches):
        for batch in batches:
            buf, off = flat(batch["text"])
            content, ents, terms = [], [], []
            for i in _candidates(buf, off).tolist():
                text = buf[off[i] : off[i + 1]].tobytes().decode()
                d = _Document(text)
                if d.spans:
                    content.append(_hash(text))
                    ents.append(np.unique(d.entities))
                    terms.append(np.unique(d.terms))
            if content:
                flat_ = lambda x: lists(signed(np.concatenate(x)), np.array([len(y) for y in x]))
                yield pa.RecordBatch.from_arrays([signed(np.array(content, np.uint64)), flat_(ents), flat_(terms)], ["content", "entities", "terms"])

    return need(documents, text_col).toDF("text").where("text is not null").mapInArrow(run, "content long, entities array<long>, terms array<long>")


def _term_counts(documents: DataFrame, wanted: DigestArray, text_col: str) -> DataFrame:
    """(term, n): the number of documents that hold each wanted term."""

    def run(batches):
        for batch in batches:
            buf, off = flat(batch["text"])
            for a, b in chunks(off):
                w = Words(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                keys, inverse = np.unique(w.hash, return_inverse=True)
                known = wanted.has(keys)
                at = np.flatnonzero(known[inverse])
                pair = np.unique(inverse[at] * np.int64(b - a) + w.owner[at])
                term, n = np.unique(pair // (b - a), return_counts=True)
                if len(term):
                    yield pa.RecordBatch.from_arrays([signed(keys[term]), pa.array(n)], ["term", "n"])

    rows = need(documents, text_col).toDF("text").where("text is not null").mapInArrow(run, "term long, n long")
    return rows.groupBy("term").agg(F.sum("n").alias("n_t"))


def _lower_limit(n: int) -> float:
    """The mean at which a Poisson count reaches n with probability 0.05."""
    low, high = 0.0, float(n)
    for _ in range(60):
        mean = (low + high) / 2
        fewer = sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(n))
        low, high = (mean, high) if 1 - fewer < 0.05 else (low, mean)
    return low


def _estimates(documents: DataFrame, min_support: int, text_col: str) -> DataFrame:
    """(keys, term, n_e, n_t, n_et, texts, share) of each entity and term that a text holds.

    keys is the entity's hash, or, for all entities that are only in the same texts, fewer than `min_support`, those texts' hashes.
    """
    bags = written(_bags(documents, text_col).groupBy("content").agg(F.count(F.lit(1)).alias("n"), F.first("entities").alias("entities"), F.first("terms").alias("terms")), "bags")
    held = bags.select("content", "n", "terms", F.explode("entities").alias("entity"))
    known = held.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count(F.lit(1)).alias("texts"))
    often = known.where(F.col("texts") >= min_support).drop("texts")
    often = held.join(often, "entity").select(F.array("entity").alias("keys"), "n_e", "n", F.explode("terms").alias("term"))
    rare = held.select("content", "entity").join(known.where(F.col("texts") < min_support).drop("texts"), "entity")
    rare = rare.groupBy("entity", "n_e").agg(F.sort_array(F.collect_list("content")).alias("keys")).select("keys", "n_e").distinct()
    rare = rare.withColumn("content", F.explode("keys")).join(bags.select("content", "n", "terms"), "content").select("keys", "n_e", "n", F.explode("terms").alias("term"))
    pairs = often.unionByName(rare).groupBy("keys", "n_e", "term").agg(F.sum("n").alias("n_et"), F.count(F.lit(1)).alias("texts"))
    pairs = written(pairs, "pairs")
    counts = _term_counts(documents, DigestArray.store(pairs.select("term"), "term", None, "terms"), text_col)
    total = documents.where(documents[text_col].isNotNull()).agg(F.count(F.lit(1)).alias("total"))
    rows = pairs.join(counts, "term").crossJoin(F.broadcast(total))  # one row
    sure = F.lit(1.0)
    for n in range(1, min_support):
        sure = F.when(F.col("texts") == n, _lower_limit(n) / n).otherwise(sure)
    share = F.log(F.col("n_et") * sure * F.col("total") / (F.col("n_e") * F.col("n_t"))) / F.log(F.col("total") / F.col("n_e"))
    return rows.select("keys", "term", "n_e", "n_t", "n_et", "texts", F.when(F.col("n_e") < F.col("total"), share).otherwise(0.0).alias("share"))


def disclosure_table(documents: DataFrame, *, min_support: int = MIN_SUPPORT, text_col: str = "text") -> DataFrame:
    """(entity, term, n_e, n_t, n_et, share) of pairs in `min_support` texts: hashes, document counts and the share of the entity's information that the term discloses."""
    rows = _estimates(documents, min_support, text_col).where(F.col("texts") >= min_support)
    return rows.select(F.col("keys")[0].alias("entity"), "term", "n_e", "n_t", "n_et", "share")


def fit(documents: DataFrame, *, min_support: int = MIN_SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, text_col: str = "text") -> Disclosures:
    """Estimates, over all documents, which terms disclose which entities."""
    table = _estimates(documents, min_support, text_col).where(F.col("share") >= generalise).withColumn("key", F.explode("keys"))
    action = F.when(F.col("share") >= remove, F.lit(1)).otherwise(F.lit(0)).cast("long")
    rows = table.select("key", F.col("term").bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(action).alias("term"))
    return Disclosures(DigestArray.store(rows, "key", "term", "disclosures"))


def sanitised_text(found: Disclosures, text: str | Column) -> Column:
    def run(column: pa.Array) -> pa.Array:
        return found(column)[0]

    return F.arrow_udf(run, "string")(text)


def sanitise(documents: DataFrame, found: Disclosures, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, entities, generalised, removed) of every document."""

    def run(column: pa.Array) -> pa.Array:
        text, counts = found(column)
        return pa.StructArray.from_arrays([text, *(pa.array(counts[:, k]) for k in range(3))], ["text", "entities", "generalised", "removed"])

    docs = need(documents, id_col, text_col).toDF("id", "text")
    return docs.select(F.col("id").alias(id_col), F.arrow_udf(run, _RESULT)("text").alias("s")).select(id_col, "s.*")


__all__ = ["Disclosures", "disclosure_table", "entity_spans", "fit", "sanitise", "sanitised_text"]
