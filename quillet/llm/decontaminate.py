"""Benchmark decontamination by template canonicalisation.

Texts become sequences of template tokens: a number (digits, also written out in English, German, French or Spanish), a
name (a capitalised word inside a sentence) and a unit (of those languages) become the typed placeholders
NUM, NAME and UNIT, neighbouring numbers and neighbouring names being one; any other
word is itself.  Windows of `window` template tokens of the benchmark are
hash-joined with those of the documents.  Along each alignment of a document with an
item the placeholders' values must then be consistent: one value of the item always
stands against one value of the document and the other way round.  That keeps
re-parameterised questions ("Ann has 3 kg" / "Bob has 7 kg") and drops chance
matches; of an inconsistent alignment only the windows without placeholders count.
Windows with fewer words than `min_words`, and items of fewer than `MIN_ITEM` tokens, would match by chance as
templates: they are joined on their words and values, so a verbatim copy counts, in any alignment.

A document is contaminated by an item if the matched windows cover `min_cover`
tokens of it, or half of the item if that is less.

Scale: the benchmark's window hashes are a digest array in the shared folder that
every task memory-maps, so documents are filtered in one map without a shuffle or a
broadcast that grows; only windows with a known hash go on to the hash join.

Defined results: null and empty texts and null ids match nothing; an item
shorter than a window is searched whole, one of a single token only matches a document of that token; an item or a
document in several rows counts as the union of its rows.  Other columns are not looked at, whatever their names.  German nouns are
capitalised like names; they stand for NAME on both sides alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DigestArray, need, signed, written
from .textops import Words, chunks, flat, fold, grams, lists, mix, span_hash, within

WINDOW = 8
MIN_COVER = 13
MIN_ITEM = 4
#: Of a window's tokens, so many at least are words, or its values must be equal.
MIN_WORDS = 0.5

#: Words that are nothing else in another of the four languages: not one, un, ein, neuf (new), elf, seize, once, dos, an (French year), livre, metro and the like.
NUMBERS = " ".join((
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion",
    "zwei drei vier fünf sechs sieben acht neun zehn zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend millionen",
    "zéro deux trois quatre cinq sept huit dix onze douze treize quatorze quinze vingt trente quarante cinquante soixante mille millions",
    "cero tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil millón millones",
))
UNITS = " ".join((
    "mm cm m km inch inches foot feet yard yards mile miles g kg mg gram grams kilogram kilograms pound pounds lb lbs ounce ounces oz ton tons tonne tonnes ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents usd eur percent meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters mph kmh kph degree degrees celsius fahrenheit joule joules watt watts volt volts hz khz mhz ghz kb mb gb tb",
    "gramm kilogramm pfund tonnen sekunde sekunden minuten stunde stunden tage tagen woche wochen monat monate monaten jahr jahre jahren prozent zentimeter millimeter",
    "gramme grammes kilogramme kilogrammes mètre mètres kilomètre kilomètres centimètre centimètres seconde secondes heure heures jour jours semaine semaines mois année années degré degrés",
    "gramo gramos kilogramo kilogramos kilo kilos libra libras tonelada toneladas kilómetro kilómetros centímetro centímetros litro litros segundo segundos minuto minutos hora horas día días semana semanas meses año años grado grados",
))

_ROW = "hash long, width int, id {kind}, pos int, n int, slots array<long>"


def _set(words: str) -> np.ndarray:
    raw = np.frombuffer(words.encode(), np.uint8)
    return np.unique(Words(raw, np.array([0, len(raw)])).hash)


_NUMBER_WORDS, _UNIT_WORDS = _set(NUMBERS), _set(UNITS)
_SLOTS = mix(np.arange(1, 4, dtype=np.uint64))


class Template:
    """The template tokens of a chunk: hash, kind (0 word, 1 NUM, 2 NAME, 3 UNIT), value's hash and document."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        low = fold(buf)
        words = Words(buf, off, folded=low)
        s, e, owner = words.starts, words.ends, words.owner
        kind = np.zeros(len(s), np.int8)
        if len(s):
            digits = np.zeros(len(buf) + 1, np.int64)
            np.cumsum((buf >= 48) & (buf <= 57), out=digits[1:])
            kind[np.isin(words.hash, _UNIT_WORDS)] = 3
            kind[(digits[e] - digits[s] == e - s) | np.isin(words.hash, _NUMBER_WORDS)] = 1
            stops = np.zeros(len(buf) + 1, np.int64)
            np.cumsum((buf == 46) | (buf == 33) | (buf == 63) | (buf == 58) | (buf == 10), out=stops[1:])
            before = np.zeros(len(s), np.int64)
            before[1:] = e[:-1]
            opens = (stops[s] > stops[before]) | np.append(True, owner[1:] != owner[:-1])
            one, two = buf[s], buf[np.minimum(s + 1, len(buf) - 1)]
            wide = one >= 0x80
            upper = ((one >= 65) & (one <= 90)) | ((one == 0xC3) & (two >= 0x80) & (two <= 0x9E))
            after = np.minimum(s + np.where(wide, 2, 1), len(buf) - 1)
            wider = np.minimum(after + 1, len(buf) - 1)
            lower = (e > after) & (s < after) & (low[after] == buf[after]) & (buf[after] >= 97) & ((buf[after] < 0x80) | (low[wider] == buf[wider]))
            kind[upper & lower & ~opens & (kind == 0)] = 2
            first = np.ones(len(s), bool)
            first[1:] = ~((kind[1:] == kind[:-1]) & ((kind[1:] == 1) | (kind[1:] == 2)) & (owner[1:] == owner[:-1]))
            last = np.append(first[1:], True)
        else:
            first = last = np.zeros(0, bool)
        self.kind, self.owner = kind[first], owner[first]
        self.hash = words.hash[first].copy()
        self.value = self.hash.copy()
        slot = np.flatnonzero(self.kind)
        self.hash[slot] = _SLOTS[self.kind[slot] - 1]
        self.value[slot] = span_hash(low, s[first][slot], e[last][slot])
        self.first = np.searchsorted(self.owner, np.arange(len(off)))

    def windows(self, width: int, min_words: float) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the windows that lie in one document and have words enough."""
        if len(self.hash) < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        plain = np.zeros(len(self.kind) + 1, np.int64)
        np.cumsum(self.kind == 0, out=plain[1:])
        ok = within(self.owner, width) & (plain[width:] - plain[:-width] >= min_words * width)
        at = np.flatnonzero(ok)
        return at, grams(self.hash, width)[at]

    def exact(self, width: int, min_words: float) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes of words and values) of the other windows that lie in one document."""
        if len(self.hash) < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        ok = within(self.owner, width)
        if width >= MIN_ITEM:
            ok[self.windows(width, min_words)[0]] = False
        elif width == 1:
            ok &= np.diff(self.first)[self.owner] == 1
        at = np.flatnonzero(ok)
        return at, mix(~grams(self.value, width)[at])

    def searched(self, width: int, min_words: float) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """(places, hashes, whether values are left to be compared) of all windows."""
        return ([(*self.windows(width, min_words), True)] if width >= MIN_ITEM else []) + [(*self.exact(width, min_words), False)]

    def slots(self, at: np.ndarray, width: int) -> pa.Array:
        """The values' hashes in each window, in order."""
        spread = (at[:, None] + np.arange(width)).ravel()
        holds = self.kind[spread] > 0 if len(spread) else np.zeros(0, bool)
        return lists(signed(self.value[spread[holds]]), holds.reshape(-1, width).sum(1) if len(at) else np.zeros(0, np.int64))


def _rows(t: Template, ids: pa.Array, at: np.ndarray, h: np.ndarray, width: int, open_: bool) -> pa.RecordBatch:
    owner = t.owner[at]
    n = np.diff(t.first)[owner]
    return pa.RecordBatch.from_arrays(
        [signed(h), pa.array(np.full(len(at), width), pa.int32()), ids.take(pa.array(owner)), pa.array(at - t.first[owner], pa.int32()), pa.array(n, pa.int32()), t.slots(at, width) if open_ else lists(signed(h[:0]), np.zeros(len(at), np.int64))],
        ["hash", "width", "id", "pos", "n", "slots"],
    )


def benchmark_windows(benchmark: DataFrame, *, window: int, min_words: float, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            buf, off = flat(batch["text"])
            for a, b in chunks(off):
                t = Template(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                n = np.diff(t.first)
                ids = batch["id"].slice(a, b - a)
                for width in range(1, window + 1):
                    for at, h, open_ in t.searched(width, min_words):
                        fits = n[t.owner[at]] >= window if width == window else n[t.owner[at]] == width
                        if fits.any():
                            yield _rows(t, ids, at[fits], h[fits], width, open_)

    items = need(benchmark, id_col, text_col).toDF("id", "text").where("id is not null and text is not null")
    return items.mapInArrow(run, _ROW.format(kind=items.schema["id"].dataType.simpleString())).distinct()


def matches(documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, min_cover: int = MIN_COVER, min_words: float = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, covered, item_tokens, changed) of each document and item that contaminates it.

    `changed` tells whether a placeholder's value differs from the item's, that is, whether the question was re-parameterised.
    """
    known = written(benchmark_windows(benchmark, window=window, min_words=min_words, id_col=item_col, text_col=item_text_col), "windows")
    widths = sorted(r.width for r in known.select("width").distinct().collect())
    digests = DigestArray.store(known, "hash", None, "digests")

    def run(batches):
        for batch in batches:
            buf, off = flat(batch["text"])
            for a, b in chunks(off):
                t = Template(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                for width in widths:
                    for at, h, open_ in t.searched(width, min_words):
                        hit = digests.has(h)
                        if hit.any():
                            yield _rows(t, batch["id"].slice(a, b - a), at[hit], h[hit], width, open_)

    docs = need(documents, id_col, text_col).toDF("id", "text").where("id is not null and text is not null")
    rows = docs.mapInArrow(run, _ROW.format(kind=docs.schema["id"].dataType.simpleString())).distinct()
    item = known.select("hash", "width", F.col("id").alias("item"), F.col("pos").alias("item_pos"), F.col("n").alias("item_n"), F.col("slots").alias("item_slots"))
    both = rows.join(item, ["hash", "width"])
    both = both.withColumn("w", F.struct("item_pos", "width", F.arrays_zip("item_slots", "slots").alias("z")))
    line = both.groupBy("id", "item", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.collect_list("w").alias("ws"), F.max("item_n").alias("n"))
    line = line.withColumn("z", F.expr("array_distinct(flatten(transform(ws, w -> w.z)))"))
    line = line.withColumn("sound", F.expr("size(array_distinct(transform(z, p -> p.item_slots))) = size(z) and size(array_distinct(transform(z, p -> p.slots))) = size(z)"))
    line = line.withColumn("ws", F.expr("if(sound, ws, filter(ws, w -> size(w.z) = 0))"))
    line = line.withColumn("changed", F.expr("sound and exists(z, p -> p.item_slots <> p.slots)"))
    line = line.withColumn("tokens", F.expr("array_distinct(flatten(transform(ws, w -> sequence(w.item_pos, w.item_pos + w.width - 1))))"))
    out = line.groupBy("id", "item").agg(F.expr("size(array_distinct(flatten(collect_list(tokens))))").alias("covered"), F.max("n").alias("item_tokens"), F.max("changed").alias("changed"))
    out = out.where(F.col("covered") >= F.least(F.lit(min_cover), F.ceil(F.col("item_tokens") / 2)))
    return out.where("covered > 0").select(F.col("id").alias(id_col), F.col("item").alias("item_id"), "covered", "item_tokens", "changed")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **kwargs) -> DataFrame:
    """The documents that no item contaminates; columns stay."""
    found = written(matches(documents, benchmark, id_col=id_col, **kwargs).select(F.col(id_col).alias("gone")).distinct(), "contaminated")
    return documents.join(found, documents[id_col] == found["gone"], "left_anti")
