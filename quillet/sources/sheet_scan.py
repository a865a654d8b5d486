"""Sheets scanned in columns.

The plain form in which nearly all writers put their cells is read some megabytes at a time and decoded by
whole columns.  The tags of a piece are found and told apart by NumPy, and must follow each other as in that
form; a piece that has, say, a bare > in a text is read by one regular expression, which must cover each of
its bytes.  From the first piece that holds anything else on, the sheet is read by the XML parser instead.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KINDS = ("blank", "string", "bool", "error", "date", "number")
BLANK, STRING, BOOL, ERROR, DATE, NUMBER = range(6)
PIECE = 4 << 20
BATCH = 50_000

_TOKEN = re.compile(
    rb'(<row r="([0-9]+)"[^<>]*>|</row>|<c r="([A-Z]{1,3})[0-9]+"(?: s="([0-9]+)")?(?: t="(\w+)")?(?:/>|></c>'
    rb'|>(?:<f>([^<]+)</f>)?(?:<v>([^<]+)</v>)?(?:(<is><t(?: xml:space="preserve")?>)([^<]*)</t></is>)?</c>))'
)
_REFERENCE = re.compile("&(?:lt|gt|amp|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);")
_NAMED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}
_EPOCH_US = -2_209_161_600_000_000  # 1899-12-30
_FIRST_US, _LAST_US = -62_135_596_800_000_000, 253_402_300_799_999_999


@dataclass
class Columns:
    """Cells in columns; text, number, flag and time count for the kinds they belong to."""

    row: np.ndarray
    col: np.ndarray
    kind: np.ndarray
    text: pa.Array
    number: np.ndarray
    flag: np.ndarray
    time: np.ndarray
    formula: pa.Array

    def __len__(self) -> int:
        return len(self.row)

    def since(self, n: int) -> Columns:
        return Columns(*(x[n:] if isinstance(x, np.ndarray) else x.slice(n) for x in vars(self).values()))

    def value(self, i: int):
        k = self.kind[i]
        if k in (STRING, ERROR):
            return self.text[i].as_py()
        if k == DATE:
            return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=int(self.time[i]))
        return None if k == BLANK else bool(self.flag[i]) if k == BOOL else float(self.number[i])


def of_cells(cells: list[tuple]) -> Columns:
    """Columns of (row, column, kind, value, formula)."""
    row, col, kind, value, formula = zip(*cells)
    pick = lambda names, zero, f: [f(v) if k in names and v is not None else zero for k, v in zip(kind, value)]
    return Columns(
        np.array(row, np.int64),
        np.array(col, np.int64),
        np.array([KINDS.index(k) for k in kind], np.int8),
        pa.array(pick(("string", "error"), None, str), pa.string()),
        np.array(pick(("number",), 0.0, float)),
        np.array(pick(("bool",), False, bool)),
        np.array(pick(("date",), 0, lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)), np.int64),
        pa.array(formula, pa.string()),
    )


def _unescaped(a: pa.Array) -> pa.Array:
    """Character references replaced; ValueError for one that XML doesn't know."""

    def put(m: re.Match) -> str:
        x = m[0][1:-1]
        return _NAMED.get(x) or chr(int(x[2:], 16) if x[1] == "x" else int(x[1:]))

    some = pc.fill_null(pc.match_substring(a, "&"), False)
    old = a.filter(some).to_pylist()
    if any(len(_REFERENCE.findall(x)) != x.count("&") for x in old):
        raise ValueError("an unknown reference")
    return pc.replace_with_mask(a, some, pa.array([_REFERENCE.sub(put, x) for x in old], pa.string())) if old else a


@dataclass
class _Cells:
    """The cells of a piece before they are decoded; empty ones too."""

    row: np.ndarray
    col: np.ndarray
    kinds: list[bytes]  # the types that occur
    kind: np.ndarray  # a place in kinds
    style: np.ndarray  # -1 if there is none
    has: np.ndarray  # whether there is a value
    in_place: np.ndarray  # whether there is a text in place
    value: Callable[[np.ndarray], pa.Array]  # the values of the cells at some places
    text: Callable[[np.ndarray], pa.Array]  # texts in place, or else values; null where the mask is false
    formula: pa.Array


# the tags of a sheet's rows, and which of them may follow which
_ROW, _END_ROW, _CELL, _EMPTY, _END_CELL, _F, _END_F, _V, _END_V, _IS, _END_IS, _T, _END_T = range(1, 14)
_OPENS, _CLOSES, _LENGTH = np.zeros(256, np.int8), np.zeros(256, np.int8), np.zeros(14, np.int64)
for _c, _code in zip(b"rcfvit", (_ROW, _CELL, _F, _V, _IS, _T)):
    _OPENS[_c] = _code
for _c, _code in zip(b"rcfvit", (_END_ROW, _END_CELL, _END_F, _END_V, _END_IS, _END_T)):
    _CLOSES[_c] = _code
_LENGTH[[_END_ROW, _END_CELL, _F, _END_F, _V, _END_V, _IS, _END_IS, _END_T]] = 5, 3, 2, 3, 2, 3, 3, 4, 3
_FOLLOWS = np.zeros((14, 14), bool)
for _code, _next in {
    _ROW: (_CELL, _EMPTY, _END_ROW),
    _END_ROW: (_ROW,),
    _CELL: (_F, _V, _IS, _END_CELL),
    _EMPTY: (_CELL, _EMPTY, _END_ROW),
    _END_CELL: (_CELL, _EMPTY, _END_ROW),
    _F: (_END_F,),
    _END_F: (_V, _IS, _END_CELL),
    _V: (_END_V,),
    _END_V: (_IS, _END_CELL),
    _IS: (_T,),
    _T: (_END_T,),
    _END_T: (_END_IS,),
    _END_IS: (_END_CELL,),
}.items():
    _FOLLOWS[_code, _next] = True
_ATTRIBUTES = re.compile(rb'(?: s="([0-9]+)")?(?: t="(\w+)")?/?')


def _flags(tags: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(14, bool)
    out[list(tags)] = True
    return out


def _slices(raw: bytes, start: np.ndarray, end: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The texts between places, which must ascend."""
    n = len(start)
    if not n:
        return pa.array([], pa.string())
    places = np.stack([start, end], 1).astype(np.int32)
    all_ = pa.StringArray.from_buffers(2 * n - 1, pa.py_buffer(places), pa.py_buffer(raw))
    out = all_.take(pa.array(np.arange(0, 2 * n, 2, dtype=np.int32)))
    return out if valid is None else pa.StringArray.from_buffers(n, out.buffers()[1], out.buffers()[2], pa.array(valid).buffers()[1])


def _is(b: np.ndarray, at: np.ndarray, text: bytes) -> bool:
    return all((b[at + k] == x).all() for k, x in enumerate(text))


def _number(b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of 1 to 8 digits at places, and the places after them."""
    at, out = at.copy(), np.zeros(len(at), np.int64)
    for k in range(8):
        x = b[at] - np.uint8(48)
        digit = x < 10
        if k == 0 and not digit.all():
            raise ValueError("not a number")
        if not digit.any():
            break
        out = np.where(digit, out * 10 + x, out)
        at += digit
    return out, at


def _by_tags(raw: bytes) -> _Cells:
    """The cells of a piece in plain form without a bare >; ValueError if it isn't."""
    if not raw.isascii():
        raw.decode()
    b = np.frombuffer(raw + b"\0" * 16, np.uint8)
    lt, gt = np.flatnonzero(b == ord("<")), np.flatnonzero(b == ord(">"))
    if not len(lt) or len(lt) != len(gt) or lt[0] or gt[-1] != len(raw) - 1 or (gt < lt).any() or (gt[:-1] > lt[1:]).any():
        raise ValueError("a bare >, or something around the tags")
    first, second = b[lt + 1], b[lt + 2]
    code = np.where(first == ord("/"), _CLOSES[second], _OPENS[first])
    code[(code == _CELL) & (b[gt - 1] == ord("/"))] = _EMPTY
    if code[0] != _ROW or code[-1] != _END_ROW or not _FOLLOWS[code[:-1], code[1:]].all():
        raise ValueError("tags in another order")
    long = _LENGTH[code]
    gap = lt[1:] - gt[:-1] - 1
    holds = _flags((_F, _V, _T))[code[:-1]]
    if not ((long == 0) | (gt - lt == long)).all() or (gap[~holds] != 0).any() or (gap[holds & (code[:-1] != _T)] == 0).any():
        raise ValueError("not in plain form")
    where = lambda *x: np.flatnonzero(_flags(x)[code])
    rows, cells, texts = where(_ROW), where(_CELL, _EMPTY), where(_T)
    spaced = texts[gt[texts] - lt[texts] != 2]
    if not (_is(b, lt[rows], b'<row r="') and _is(b, lt[cells], b'<c r="') and _is(b, lt[where(_END_ROW)], b"</ro") and _is(b, lt[where(_END_ROW)] + 4, b"w>") and _is(b, lt[where(_IS)], b"<is>") and _is(b, lt[where(_END_IS)], b"</is>")):
        raise ValueError("another tag")
    if (gt[spaced] - lt[spaced] != 23).any() or not _is(b, lt[spaced], b'<t xml:space="preserve">'):
        raise ValueError("another attribute")
    number, after = _number(b, lt[rows] + 8)
    if (b[after] != ord('"')).any():
        raise ValueError("not a row")
    at = lt[cells] + 6
    col = np.zeros(len(cells), np.int64)
    for k in range(3):
        x = b[at] - np.uint8(64)
        letter = (x >= 1) & (x <= 26)
        if k == 0 and not letter.all():
            raise ValueError("not a column")
        col = np.where(letter, col * 26 + x, col)
        at += letter
    _, at = _number(b, at)
    if (b[at] != ord('"')).any():
        raise ValueError("not a reference")
    attributes = _slices(raw, at + 1, gt[cells]).dictionary_encode()
    known: dict[bytes, int] = {}
    kind, style = [], []
    for x in attributes.dictionary.to_pylist():
        m = _ATTRIBUTES.fullmatch(x.encode())
        if not m or len(m[1] or b"") > 9:
            raise ValueError("another attribute")
        kind.append(known.setdefault(m[2] or b"", len(known)))
        style.append(int(m[1]) if m[1] else -1)
    which = attributes.indices.to_numpy()
    count = len(cells)
    owner = np.cumsum(_flags((_CELL, _EMPTY))[code], dtype=np.int32) - 1

    def spans(tag: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each cell has the tag, and where the tag's text begins and ends."""
        i = where(tag)
        has, start = np.zeros(count, bool), lt[cells]
        end = start.copy()
        has[owner[i]], start[owner[i]], end[owner[i]] = True, gt[i] + 1, lt[i + 1]
        return has, start, end

    has, v0, v1 = spans(_V)
    in_place, t0, t1 = spans(_T)
    formulas, f0, f1 = spans(_F)
    t0, t1 = np.where(in_place, t0, v0), np.where(in_place, t1, v1)
    return _Cells(
        number[np.cumsum(code == _ROW, dtype=np.int32)[cells] - 1],
        col,
        list(known),
        np.array(kind, np.int64)[which],
        np.array(style, np.int64)[which],
        has,
        in_place,
        lambda i: _slices(raw, v0[i], v1[i]),
        lambda mask: _slices(raw, np.where(mask, t0, v0), np.where(mask, t1, v0), mask),
        _slices(raw, f0, f1, formulas) if formulas.any() else pa.nulls(count, pa.string()),
    )


def _by_tokens(raw: bytes) -> _Cells:
    """The cells of a piece in plain form; ValueError if it isn't."""
    tokens = _TOKEN.findall(raw)
    if not tokens:
        raise ValueError("no token")
    whole, row, letters, style, kind, formula, value, inline, text = zip(*tokens)
    if sum(map(len, whole)) != len(raw) or not row[0]:
        raise ValueError("not in plain form")
    array = lambda x: pa.array(x, pa.binary()).cast(pa.string())
    is_cell = np.fromiter(map(bool, letters), bool, len(letters))
    starts = np.fromiter(map(bool, row), bool, len(row))
    number_of = np.array([int(x) for x in row if x], np.int64)
    at = np.flatnonzero(is_cell)
    rows = number_of[np.cumsum(starts)[at] - 1]
    pick = lambda x: array(x).take(pa.array(at))
    names = pick(letters).dictionary_encode()
    index = []
    for s in names.dictionary.to_pylist():
        n = 0
        for c in s:
            n = 26 * n + ord(c) - 64
        index.append(n)
    col = np.array(index, np.int64)[names.indices.to_numpy()] if index else np.zeros(0, np.int64)
    kinds = pick(kind).dictionary_encode()
    s = pick(style)
    styled = pc.greater(pc.binary_length(s), 0)
    style_of = pc.fill_null(pc.cast(pc.if_else(styled, s, pa.scalar(None, pa.string())), pa.int64()), -1).to_numpy(zero_copy_only=False)
    v, t, f = pick(value), pick(text), pick(formula)
    has = pc.greater(pc.binary_length(v), 0).to_numpy(zero_copy_only=False)
    in_place = np.fromiter(map(bool, inline), bool, len(inline))[at]
    none = pa.scalar(None, pa.string())
    return _Cells(
        rows,
        col,
        [x.encode() for x in kinds.dictionary.to_pylist()],
        kinds.indices.to_numpy().astype(np.int64),
        style_of,
        has,
        in_place,
        lambda i: v.take(pa.array(i)),
        lambda mask: pc.if_else(pa.array(mask), pc.if_else(pa.array(in_place), t, v), none),
        pc.if_else(pc.greater(pc.binary_length(f), 0), f, none),
    )


def _piece(raw: bytes, strings: pa.Array, dates: np.ndarray, shift: int) -> Columns:
    """The cells of a piece in plain form; ValueError if it isn't."""
    if b"\r" in raw:
        raise ValueError("not in plain form")
    try:
        x = _by_tags(raw)
    except ValueError:
        x = _by_tokens(raw)
    if x.col.max(initial=0) > 16_384:
        raise ValueError("not a column")
    count, has, in_place = len(x.row), x.has, x.in_place
    is_ = lambda *names: np.array([k in names for k in x.kinds], bool)[x.kind] if count else np.zeros(0, bool)
    shared, flag, error, plain, iso, numeric = is_(b"s"), is_(b"b"), is_(b"e"), is_(b"str"), is_(b"d"), is_(b"", b"n", b"inlineStr")
    if iso.any() or not (shared | flag | error | plain | numeric).all():
        raise ValueError("a kind of cell that is rare")
    numeric &= has & ~in_place
    code = np.full(count, BLANK, np.int8)
    code[(shared | plain) & has | in_place] = STRING
    code[flag & has & ~in_place], code[error & has & ~in_place] = BOOL, ERROR
    number, time = np.zeros(count), np.zeros(count, np.int64)
    n = np.flatnonzero(numeric)
    number[n] = pc.cast(x.value(n), pa.float64()).to_numpy(zero_copy_only=False)
    code[n] = NUMBER
    if dates.any():
        style = np.where(x.style[n] < 0, 0, x.style[n])
        known = style < len(dates)
        day = n[known][dates[style[known]]]
        day = day[np.abs(number[day]) < 1e8]
        us = _EPOCH_US + np.rint((number[day] + shift) * 86_400_000).astype(np.int64) * 1000
        ok = (us >= _FIRST_US) & (us <= _LAST_US)
        time[day[ok]], code[day[ok]] = us[ok], DATE
    t, f = x.text(in_place | (plain | error) & has), x.formula
    if b"&" in raw:
        t, f = _unescaped(t), _unescaped(f)
    refs = np.flatnonzero(shared & has & ~in_place)
    if len(refs):
        ids = np.zeros(count, np.int64)
        ids[refs] = pc.cast(x.value(refs), pa.int64()).to_numpy(zero_copy_only=False)
        if ids.max() >= len(strings) or ids.min() < 0:
            raise ValueError("a string that isn't there")
        mask = np.ones(count, bool)
        mask[refs] = False
        t = pc.coalesce(t, strings.take(pa.array(ids, mask=mask)))
    flags = np.zeros(count, bool)
    i = np.flatnonzero(code == BOOL)
    flags[i] = pc.equal(x.value(i), "1").to_numpy(zero_copy_only=False)
    out = Columns(x.row, x.col, code, t, number, flags, time, f)
    if f.null_count == count and (code != BLANK).all():
        return out
    keep = np.flatnonzero((code != BLANK) | f.is_valid().to_numpy(zero_copy_only=False))
    return out if len(keep) == count else Columns(*(y[keep] if isinstance(y, np.ndarray) else y.take(pa.array(keep)) for y in vars(out).values()))


def scan(raw: bytes, strings: pa.Array, dates: np.ndarray, shift: int, slow: Iterable[tuple]) -> Iterator[Columns]:
    """The cells of a sheet's part, whole rows at a time; `slow` are those of the XML parser."""
    done, last = 0, 0
    a = raw.find(b"<sheetData>")
    b = raw.find(b"</sheetData>", a)
    head = raw[:200]
    # one encoding, no second sheetData in a comment, nothing before the first row
    if a >= 0 and b >= 0 and raw.count(b"<sheetData") == 1 and b"\x00" not in head and (b"encoding=" not in head or re.search(rb"encoding=[\"'](?i:utf-8)[\"']", head)):
        a += len(b"<sheetData>")
        try:
            while a < b:
                cut = raw.find(b"</row>", min(a + PIECE, b), b)
                stop = b if cut < 0 else cut + len(b"</row>")
                c = _piece(raw[a:stop], strings, dates, shift)
                if len(c):
                    if c.row[0] <= last:
                        raise ValueError("rows out of order")
                    done, last = done + len(c), int(c.row[-1])
                    yield c
                a = stop
            return
        except (ValueError, pa.ArrowInvalid):
            pass
    held: list[tuple] = []
    for cell in islice(slow, done, None):
        if len(held) >= BATCH and cell[0] != held[-1][0]:
            yield of_cells(held)
            held = []
        held.append(cell)
    if held:
        yield of_cells(held)


__all__ = ["KINDS", "Columns", "scan"]
