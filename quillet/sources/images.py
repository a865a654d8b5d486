"""Image headers: type, size in pixels and resolution."""

from __future__ import annotations

import struct

from ..functions.codes import CONTENT_TYPES, EMU_PER_POINT


def sniff(data: bytes) -> str | None:
    """An image's type by its first bytes."""
    for head, kind in ((b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpg"), (b"GIF8", "gif"), (b"BM", "bmp"), (b"II*\0", "tif"), (b"MM\0*", "tif"), (b"\xd7\xcd\xc6\x9a", "wmf"), (b"\x01\0\x09\0", "wmf")):
        if data.startswith(head):
            return CONTENT_TYPES[kind]
    return CONTENT_TYPES["emf"] if data[:4] == b"\x01\0\0\0" and data[40:44] == b" EMF" else None


def inspect(data: bytes) -> tuple[str | None, int, int, float, float]:
    """(type, width, height, horizontal and vertical dots an inch); no size for drawings and broken images."""
    kind, w, h, x, y = sniff(data), 0, 0, 96.0, 96.0
    try:
        if kind == "image/png":
            w, h = struct.unpack_from(">II", data, 16)
            at = 8
            while at + 8 <= len(data):
                n, tag = struct.unpack_from(">I4s", data, at)
                if tag == b"pHYs":
                    px, py, unit = struct.unpack_from(">IIB", data, at + 8)
                    if unit == 1 and px and py:
                        x, y = px * 0.0254, py * 0.0254
                if tag in (b"IDAT", b"IEND"):
                    break
                at += 12 + n
        elif kind == "image/jpeg":
            at = 2
            while at + 4 <= len(data):
                if data[at] != 0xFF:
                    break
                marker, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
                if marker == 0xE0 and data[at + 4 : at + 9] == b"JFIF\0":
                    unit, dx, dy = struct.unpack_from(">BHH", data, at + 11)
                    f = {1: 1.0, 2: 2.54}.get(unit)
                    if f and dx and dy:
                        x, y = dx * f, dy * f
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack_from(">HH", data, at + 5)
                    break
                at += 2 + n
        elif kind == "image/gif":
            w, h = struct.unpack_from("<HH", data, 6)
        elif kind == "image/bmp":
            w, h = struct.unpack_from("<ii", data, 18)
            h = abs(h)
            dx, dy = struct.unpack_from("<ii", data, 38)
            if dx > 0 and dy > 0:
                x, y = dx * 0.0254, dy * 0.0254
        elif kind == "image/tiff":
            e = "<" if data[:2] == b"II" else ">"
            at, = struct.unpack_from(e + "I", data, 4)
            count, = struct.unpack_from(e + "H", data, at)
            tags = {}
            for i in range(count):
                tag, t, n, raw = struct.unpack_from(e + "HHI4s", data, at + 2 + 12 * i)
                if t == 3:
                    tags[tag] = struct.unpack(e + "H", raw[:2])[0]
                elif t == 4:
                    tags[tag] = struct.unpack(e + "I", raw)[0]
                elif t == 5:
                    a, b = struct.unpack_from(e + "II", data, struct.unpack(e + "I", raw)[0])
                    tags[tag] = a / b if b else 0
            w, h = tags.get(256, 0), tags.get(257, 0)
            f = 2.54 if tags.get(296, 2) == 3 else 1.0
            x, y = (tags.get(282, 0) * f or 96.0), (tags.get(283, 0) * f or 96.0)
    except struct.error:
        w = h = 0
    return kind, w, h, x, y


def size_in_points(data: bytes) -> tuple[float, float]:
    _, w, h, x, y = inspect(data)
    return w / x * 72, h / y * 72


def emu(points: float) -> int:
    return round(points * EMU_PER_POINT)
