"""Document fingerprints by winnowing.

The normalised text (letters and digits of any script, lower case) has a rolling hash for
each run of `k` characters; of each window of `window` consecutive hashes the least
is a fingerprint, the rightmost one in case of ties, kept with its place in the original text.

Guarantee: two texts that share `k + window - 1` normalised characters in a row share a
fingerprint (and no match shorter than `k` is found but by a hash collision).

Scale: one map over the documents, nothing is shuffled.  About 2 / (window + 1) of the
characters yield a fingerprint.

Defined results: each row has a row in the result, also a repeated one; null, empty and
texts shorter than `k` have empty lists; a text with fewer than `window` runs counts as one
window; characters whose lower case is several characters stay as they are.  Other columns are not looked at.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, signed
from .textops import chunks, flat, grams, lists, mix, sliding_min, within

K = 30
WINDOW = 71


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """(hash of the lower-case character, or 0 for one that isn't kept; the lower-case character) by code point."""
    n = 0x110000
    kept = np.fromiter((chr(c).isalnum() for c in range(n)), bool, n)
    lower = np.arange(n, dtype=np.uint32)
    for c in np.flatnonzero(kept).tolist():
        s = chr(c).lower()
        if len(s) == 1:
            lower[c] = ord(s)
    return np.where(kept, mix(lower.astype(np.uint64) + np.uint64(1)) | np.uint64(1), np.uint64(0)), lower


def chunk_fingerprints(buf: np.ndarray, off: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, places in characters, documents), in order, of a chunk."""
    table, _ = _characters()
    value = table[np.frombuffer(buf.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)]
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
    begin = chars[off]
    at = np.flatnonzero(value)
    value = value[at]
    first = np.searchsorted(at, begin)
    n_doc = np.diff(first)
    owner = np.repeat(np.arange(len(off) - 1), n_doc)
    h = grams(value, k)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    best = sliding_min(h, window)
    picked = np.zeros(len(h), bool)
    picked[best[within(owner, k + window - 1)]] = True
    short = np.flatnonzero((n_doc >= k) & (n_doc < k + window - 1))
    if len(short):
        runs = n_doc[short] - k + 1
        index = np.repeat(first[short], runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        order = np.lexsort((-index, h[index], owner[index]))
        index = index[order]
        lead = np.append(True, owner[index][1:] != owner[index][:-1])
        picked[index[lead]] = True
    i = np.flatnonzero(picked)
    return h[i], at[i] - begin[owner[i]], owner[i]


def fingerprints(documents: DataFrame, *, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hashes, positions) of every document."""
    if k < 1 or window < 1:
        raise ValueError("k and window are at least 1")

    def run(column: pa.Array) -> pa.Array:
        buf, off = flat(column)
        found = [chunk_fingerprints(buf[off[a] : off[b]], off[a : b + 1] - off[a], k, window) + (a,) for a, b in chunks(off)]
        h = np.concatenate([np.zeros(0, np.uint64), *(f[0] for f in found)])
        at = np.concatenate([np.zeros(0, np.int64), *(f[1] for f in found)])
        owner = np.concatenate([np.zeros(0, np.int64), *(f[2] + f[3] for f in found)])
        sizes = np.bincount(owner, minlength=len(off) - 1)
        return pa.StructArray.from_arrays([lists(signed(h), sizes), lists(pa.array(at, pa.int32()), sizes)], ["hashes", "positions"])

    docs = need(documents, id_col, text_col).toDF("id", "text")
    found = F.arrow_udf(run, "struct<hashes:array<long>,positions:array<int>>")("text")
    return docs.select(F.col("id").alias(id_col), found.alias("f")).select(id_col, "f.hashes", "f.positions")
