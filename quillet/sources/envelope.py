"""Print settings and the checksummed envelope that carries a document to a spooler."""

from __future__ import annotations

import io
import struct
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MAGIC, VERSION = b"CVPR", 1
SETTINGS = "copies int, collate boolean, duplex int, color int, orientation int, scale int, custom_scale double, paper_width double, paper_height double, paper_name string, left double, top double, right double, bottom double, horizontal int, vertical int, silent boolean, pages string"
SCHEMA = f"struct<settings:struct<{', '.join(':'.join(c.split()) for c in SETTINGS.split(', '))}>,document:binary>"
_LAYOUT = [c.split() for c in SETTINGS.split(", ")]


@dataclass(frozen=True)
class Settings:
    copies: int = 1
    collate: bool = True
    duplex: int = 0
    color: int = 0
    orientation: int = 0
    scale: int = 0
    custom_scale: float = 1.0
    paper_width: float = 595.275590551181
    paper_height: float = 841.889763779528
    paper_name: str | None = "A4"
    left: float = 72.0
    top: float = 72.0
    right: float = 72.0
    bottom: float = 72.0
    horizontal: int = 1
    vertical: int = 1
    silent: bool = False
    pages: str = "all"


def _string(s: str) -> bytes:
    raw, n, head = s.encode(), len(s.encode()), b""
    while n >= 0x80:
        head += bytes([n & 0x7F | 0x80])
        n >>= 7
    return head + bytes([n]) + raw


class _Reader:
    def __init__(self, data: bytes):
        self.stream = io.BytesIO(data)

    def take(self, n: int) -> bytes:
        out = self.stream.read(n)
        if len(out) != n:
            raise ValueError("the envelope is cut off")
        return out

    def unpack(self, kind: str):
        return struct.unpack("<" + kind, self.take(struct.calcsize("<" + kind)))[0]

    def string(self) -> str:
        n = shift = 0
        while True:
            b = self.take(1)[0]
            n |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return self.take(n).decode()
            if shift > 28:
                raise ValueError("a text's length in the envelope is broken")


def pack(settings: Settings, document: bytes) -> bytes:
    """The envelope of a document: magic, version, flags, CRC-32, length and body."""
    out = []
    for name, kind in _LAYOUT:
        v = getattr(settings, name)
        if name == "paper_name":
            out.append(struct.pack("<?", v is not None) + (_string(v) if v is not None else b""))
        elif kind == "string":
            out.append(_string(v))
        else:
            out.append(struct.pack({"int": "<i", "boolean": "<?", "double": "<d"}[kind], v))
    body = b"".join(out) + struct.pack("<q", len(document)) + document
    return MAGIC + struct.pack("<BBIi", VERSION, 0, zlib.crc32(body), len(body)) + body


def unpack(data: bytes) -> tuple[Settings, bytes]:
    """Settings and document of an envelope; an error if it is cut off, of another version or damaged."""
    r = _Reader(data)
    if r.take(4) != MAGIC:
        raise ValueError("not an envelope")
    if (version := r.unpack("B")) != VERSION:
        raise ValueError(f"envelope version {version} isn't known")
    r.unpack("B")
    crc, n = r.unpack("I"), r.unpack("i")
    if n < 0:
        raise ValueError("the envelope's length is broken")
    body = r.take(n)
    if zlib.crc32(body) != crc:
        raise ValueError("the envelope's checksum doesn't match")
    r = _Reader(body)
    values = {}
    for name, kind in _LAYOUT:
        if name == "paper_name":
            values[name] = r.string() if r.unpack("?") else None
        else:
            values[name] = r.string() if kind == "string" else r.unpack({"int": "i", "boolean": "?", "double": "d"}[kind])
    n = r.unpack("q")
    if n < 0:
        raise ValueError("the document's length is broken")
    return Settings(**values), r.take(n)


def pack_column(settings: str | Column, document: str | Column) -> Column:
    """Envelopes of documents; settings is a struct with any of the settings' fields, missing ones by default."""

    def run(s: pa.Array, d: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(s.to_pylist(), d.to_pylist()):
            known = {k: v for k, v in (x or {}).items() if v is not None or k == "paper_name"}
            out.append(None if y is None else pack(Settings(**known), y))
        return pa.array(out, pa.binary())

    return F.arrow_udf(run, "binary")(settings, document)


def unpack_column(data: str | Column) -> Column:
    """struct(settings, document) of envelopes."""

    def run(d: pa.Array) -> pa.Array:
        kinds = {"int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
        kind = pa.struct([("settings", pa.struct([(n, kinds[k]) for n, k in _LAYOUT])), ("document", pa.binary())])
        rows = []
        for x in d.to_pylist():
            if x is None:
                rows.append(None)
            else:
                s, doc = unpack(x)
                rows.append({"settings": {n: getattr(s, n) for n, _ in _LAYOUT}, "document": doc})
        return pa.array(rows, kind)

    return F.arrow_udf(run, SCHEMA)(data)
