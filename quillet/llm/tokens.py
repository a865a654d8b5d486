"""Exact token counts of a byte-level BPE vocabulary, by counting each distinct word once.

The vocabulary's pattern always starts a new piece at a lone white space between two
characters that aren't white space, so a text can be cut there and its count is the sum of its
segments' counts.  Segments are hashed vectorised; only segments that a worker hasn't met
are encoded.  (Two of n segments share a 64-bit hash with probability n**2 / 2**65.)
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .textops import chunks, flat, span_hash

#: The vocabulary: lines of a base64 token and its rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Segments that a worker remembers; beyond it forgets all, which costs time only.
REMEMBERED = 200_000

_encoders: dict = {}
_counts: dict[str, dict[int, int]] = {}


def encoder(vocabulary: str = VOCABULARY):
    """The vocabulary's encoder, loaded once in each worker."""
    if vocabulary not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
        _encoders[vocabulary] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def _cuts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the segments: of documents, and lone white space that stands between plain letters or signs."""
    space = (buf == 32) | ((buf >= 9) & (buf <= 13)) | ((buf >= 28) & (buf <= 31))
    # Latin, Greek, Cyrillic ... two-byte letters are no white space; other leads may be
    solid = ~space & (buf < 0x80)
    before = solid.copy()
    before[1:] |= (buf[1:] >= 0x80) & (buf[:-1] >= 0xC3) & (buf[:-1] <= 0xDF)
    after = solid | ((buf >= 0xC3) & (buf <= 0xDF))
    cut = np.zeros(len(buf), bool)
    cut[1:-1] = space[1:-1] & before[:-2] & after[2:]
    starts = off[:-1][np.diff(off) > 0]
    cut[starts] = True
    return np.flatnonzero(cut)


def count_chunk(buf: np.ndarray, off: np.ndarray, vocabulary: str = VOCABULARY) -> np.ndarray:
    if not len(buf):
        return np.zeros(len(off) - 1, np.int64)
    enc, known = encoder(vocabulary), _counts.setdefault(vocabulary, {})
    start = _cuts(buf, off)
    stop = np.append(start[1:], len(buf))
    keys, first, inverse = np.unique(span_hash(buf, start, stop), return_index=True, return_inverse=True)
    counts = np.array([known.get(k, 0) for k in keys.tolist()], np.int64)
    new = np.flatnonzero(counts == 0)
    if len(known) + len(new) > REMEMBERED:
        known.clear()
    raw = buf.tobytes()
    for i, k, a, b in zip(new.tolist(), keys[new].tolist(), start[first[new]].tolist(), stop[first[new]].tolist()):
        counts[i] = known[k] = len(enc.encode_ordinary(raw[a:b].decode()))
    owner = np.searchsorted(off[1:], start, "right")
    return np.bincount(owner, counts[inverse], len(off) - 1).astype(np.int64)


def token_count(text: str | Column, vocabulary: str = VOCABULARY) -> Column:
    """The number of tokens; 0 for an empty text and for null."""

    def run(column: pa.Array) -> pa.Array:
        buf, off = flat(column)
        out = np.zeros(len(off) - 1, np.int64)
        for a, b in chunks(off):
            out[a:b] = count_chunk(buf[off[a] : off[b]], off[a : b + 1] - off[a], vocabulary)
        return pa.array(out)

    return F.arrow_udf(run, "long")(text)
