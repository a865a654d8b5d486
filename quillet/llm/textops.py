"""Vectorised text primitives shared by the corpus operators.

Everything works on Arrow string columns viewed as one flat byte buffer, so a
batch of documents is tokenised, hashed and windowed by a handful of NumPy
passes instead of a Python loop per word.  All offsets are byte offsets into the
buffer; :func:`char_index` turns them into character offsets.

Normalisation (used by every operator that says "words"):

* a word is a maximal run of ASCII letters and digits and of non-ASCII
  characters other than the C1/Latin-1 signs, general punctuation and the CJK
  punctuation block;
* case is folded for ASCII, Latin-1, basic Greek and basic Cyrillic, which keeps
  every byte offset where it was.

Nulls count as empty texts here; each operator says what it does with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are vectorised at once; a longer document is one chunk of its own.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(0x5EED))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_P = _U(0x9E3779B97F4A7C15)
_Q = _U(0xD6E8FEB86659FD93)
_Q_INV = _U(pow(int(_Q), -1, 2**64))

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)[:n]


_POW = powers(_P, 4096)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, applied so that close sums become far hashes."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    buffers = column.buffers()
    if n == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most `limit` bytes, but of one document at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def fold(buf: np.ndarray) -> np.ndarray:
    """Lower case, byte for byte."""
    low = _LOWER[buf]
    lead = buf[:-1]
    if len(buf) > 1 and (buf >= 0x80).any():
        nxt = buf[1:]
        sel = np.flatnonzero((lead == 0xC3) & (nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97))
        low[sel + 1] += 0x20
        if ((lead >= 0xCE) & (lead <= 0xD0)).any():
            sel = np.flatnonzero((lead == 0xD0) & (nxt >= 0x90) & (nxt <= 0x9F))
            low[sel + 1] += 0x20
            sel = np.flatnonzero((lead == 0xD0) & (nxt >= 0xA0) & (nxt <= 0xAF))
            low[sel], low[sel + 1] = 0xD1, nxt[sel] - 0x20
            sel = np.flatnonzero((lead == 0xCE) & (nxt >= 0x91) & (nxt <= 0x9F))
            low[sel + 1] += 0x20
            sel = np.flatnonzero((lead == 0xCE) & (nxt >= 0xA0) & (nxt <= 0xA9))
            low[sel], low[sel + 1] = 0xCF, nxt[sel] - 0x20
    return low


def word_mask(buf: np.ndarray) -> np.ndarray:
    m = _WORD[buf]
    if len(buf) > 1 and (buf >= 0x80).any():
        two = np.flatnonzero(buf[:-1] == 0xC2)
        m[two] = m[two + 1] = False
        # of shorter buffers both slices are empty
        tri = np.flatnonzero(((buf[:-2] == 0xE2) & ((buf[1:-1] == 0x80) | (buf[1:-1] == 0x81))) | ((buf[:-2] == 0xE3) & (buf[1:-1] == 0x80)))
        for k in range(3):
            m[tri + k] = False
    return m


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true; none crosses a document's border."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = mask.copy()
    start[1:] &= ~mask[:-1]
    inner = off[(off > 0) & (off < n)]
    start[inner] = mask[inner]
    stop = np.zeros(n + 1, bool)
    stop[1:n] = mask[:-1] & ~mask[1:]
    stop[n] = mask[-1]
    stop[inner] |= mask[inner - 1]
    return np.flatnonzero(start), np.flatnonzero(stop)


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are ordered and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    local = np.arange(total) - np.repeat(first, lengths)
    at = local + np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        value = _BYTE[buf[at]] * _POW[local & 4095]
        if total and int(lengths.max()) > 4096:
            value *= (local >> 12).astype(np.uint64) * _U(2) + _U(1)
        return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64))


class Words:
    """The words of a chunk of documents: hash, document, start and end of each, in order."""

    __slots__ = ("ends", "first", "hash", "n_docs", "owner", "starts")

    def __init__(self, buf: np.ndarray, off: np.ndarray, *, folded: np.ndarray | None = None):
        low = fold(buf) if folded is None else folded
        self.starts, self.ends = runs(word_mask(buf), off)
        self.hash = span_hash(low, self.starts, self.ends)
        self.n_docs = len(off) - 1
        #: first[d] .. first[d + 1] are the words of document d.
        self.first = np.searchsorted(self.starts, off)
        self.owner = np.repeat(np.arange(self.n_docs), np.diff(self.first))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i : i + k] at each i <= len(h) - k, by differences of prefix sums."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * powers(_Q, len(h)), out=total[1:])
        return mix((total[k:] - total[:-k]) * powers(_Q_INV, n))


def within(owner: np.ndarray, k: int) -> np.ndarray:
    """Which i have h[i : i + k] in one document."""
    n = len(owner) - k + 1
    return owner[:n] == owner[k - 1 :] if n > 0 else np.zeros(0, bool)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Index of the rightmost least of h[i : i + w] at each i <= len(h) - w."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = np.arange(len(h))
    span = 1
    while span * 2 <= w:
        a, b = best[: len(best) - span], best[span:]
        best = np.where(h[b] <= h[a], b, a)
        span *= 2
    a, b = best[:n], best[w - span : w - span + n]
    return np.where(h[b] <= h[a], b, a)


def char_index(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of characters before each byte (one more than there are bytes), over the whole buffer."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    """A list column from its flat values."""
    off = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), values)


class Ranges:
    """Hashes of any ranges of a sequence of hashes, in constant time each."""

    def __init__(self, h: np.ndarray):
        self.total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * powers(_Q, len(h)), out=self.total[1:])
        self.unit = powers(_Q_INV, len(h) + 1)

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.total[stop] - self.total[start]) * self.unit[start] + (stop - start).astype(np.uint64))
