"""Compound files: the container of encrypted packages."""

from __future__ import annotations

import struct

SIGNATURE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
END, FREE, FAT_SECTOR, DIFAT_SECTOR, NONE = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD, 0xFFFFFFFC, 0xFFFFFFFF
CUTOFF = 4096


def is_compound(data: bytes) -> bool:
    return data[:8] == SIGNATURE


def read_streams(data: bytes) -> dict[str, bytes]:
    """The streams of a compound file by path, storages separated by /."""
    if not is_compound(data) or len(data) < 512:
        raise ValueError("not a compound file")
    sector_shift, mini_shift = struct.unpack_from("<HH", data, 30)
    first_dir, = struct.unpack_from("<I", data, 48)
    cutoff, first_mini, n_mini, first_difat, n_difat = struct.unpack_from("<IIIII", data, 56)
    if sector_shift not in (9, 12) or mini_shift != 6:
        raise ValueError("not a compound file of a known version")
    size = 1 << sector_shift

    def sector(i: int) -> bytes:
        at = (i + 1) * size
        if i >= 0xFFFFFFFA or at >= len(data):
            raise ValueError("a sector lies beyond the compound file")
        return data[at : at + size].ljust(size, b"\0")

    difat = list(struct.unpack_from("<109I", data, 76))
    at, seen = first_difat, 0
    while at < 0xFFFFFFFA and seen <= n_difat:
        entries = struct.unpack(f"<{size // 4}I", sector(at))
        difat += entries[:-1]
        at, seen = entries[-1], seen + 1
    fat: list[int] = []
    for i in difat:
        if i < 0xFFFFFFFA:
            fat += struct.unpack(f"<{size // 4}I", sector(i))

    def chain(i: int, table: list[int]) -> list[int]:
        out = []
        while i < 0xFFFFFFFA:
            if i >= len(table) or len(out) > len(table):
                raise ValueError("a chain of sectors is broken")
            out.append(i)
            i = table[i]
        return out

    directory = b"".join(map(sector, chain(first_dir, fat)))
    entries = []
    for k in range(0, len(directory), 128):
        e = directory[k : k + 128]
        n, kind = struct.unpack_from("<HB", e, 64)
        left, right, child = struct.unpack_from("<III", e, 68)
        start, length = struct.unpack_from("<IQ", e, 116)
        if n > 64:
            raise ValueError("a directory entry's name is too long")
        entries.append((e[: max(0, n - 2)].decode("utf-16-le"), kind, left, right, child, start, length & (0xFFFFFFFF if sector_shift == 9 else 2**64 - 1)))
    mini_fat: list[int] = []
    for i in chain(first_mini, fat) if n_mini else []:
        mini_fat += struct.unpack(f"<{size // 4}I", sector(i))
    mini = b"".join(map(sector, chain(entries[0][5], fat))) if entries and entries[0][6] else b""

    def content(start: int, length: int) -> bytes:
        if not length:
            return b""
        if length < cutoff:
            return b"".join(mini[64 * i : 64 * i + 64] for i in chain(start, mini_fat))[:length]
        return b"".join(map(sector, chain(start, fat)))[:length]

    out: dict[str, bytes] = {}
    stack, done = [(entries[0][4], "")], set()
    while stack:
        i, prefix = stack.pop()
        if i >= len(entries) or i in done:
            continue
        done.add(i)
        name, kind, left, right, child, start, length = entries[i]
        stack += [(left, prefix), (right, prefix)]
        if kind == 1:
            stack.append((child, prefix + name + "/"))
        elif kind == 2:
            out[prefix + name] = content(start, length)
    return out


def write_streams(streams: dict[str, bytes]) -> bytes:
    """A compound file, version 3, of streams by path."""
    tree: dict = {}
    for path, body in streams.items():
        *folders, name = path.split("/")
        here = tree
        for f in folders:
            here = here.setdefault(f, {})
        here[name] = body
    entries: list[list] = [["Root Entry", 5, NONE, NONE, NONE, 0, b""]]

    def add(children: dict) -> int:
        """Adds a storage's children as a balanced tree in the order of length and name; returns its root."""
        names = sorted(children, key=lambda s: (len(s.encode("utf-16-le")), s.upper()))
        ids = []
        for n in names:
            ids.append(len(entries))
            body = children[n]
            entries.append([n, 1 if isinstance(body, dict) else 2, NONE, NONE, NONE, 0, b"" if isinstance(body, dict) else body])
        for n, i in zip(names, ids):
            if isinstance(children[n], dict):
                entries[i][4] = add(children[n])

        def balance(lo: int, hi: int) -> int:
            if lo >= hi:
                return NONE
            mid = (lo + hi) // 2
            entries[ids[mid]][2], entries[ids[mid]][3] = balance(lo, mid), balance(mid + 1, hi)
            return ids[mid]

        return balance(0, len(ids))

    entries[0][4] = add(tree)
    mini, mini_fat = bytearray(), []
    for e in entries[1:]:
        if e[1] == 2 and 0 < len(e[6]) < CUTOFF:
            e[5] = len(mini_fat)
            n = -(-len(e[6]) // 64)
            mini_fat += [*range(e[5] + 1, e[5] + n), END]
            mini += e[6].ljust(64 * n, b"\0")
        elif e[1] == 2 and not e[6]:
            e[5] = END
    sectors: list[bytes] = []
    fat: list[int] = []

    def put(body: bytes) -> int:
        if not body:
            return END
        start, n = len(sectors), -(-len(body) // 512)
        sectors.extend(body[512 * k : 512 * k + 512].ljust(512, b"\0") for k in range(n))
        fat.extend([*range(start + 1, start + n), END])
        return start

    for e in entries[1:]:
        if e[1] == 2 and len(e[6]) >= CUTOFF:
            e[5] = put(e[6])
    root_start = put(bytes(mini))
    mini_start = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(-(-len(mini_fat) // 128) * 512, b"\xff")) if mini_fat else END
    n_mini = -(-len(mini_fat) // 128)
    directory = bytearray()
    for i, (name, kind, left, right, child, start, body) in enumerate(entries):
        raw = name.encode("utf-16-le")
        directory += raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2, kind, 1, left, right, child) + bytes(36) + struct.pack("<IQ", root_start if i == 0 else start, len(mini) if i == 0 else len(body))
    while len(directory) % 512:
        directory += bytes(66) + b"\0\0" + struct.pack("<III", NONE, NONE, NONE) + bytes(48)
    dir_start = put(bytes(directory))
    n_fat = n_difat = 0
    while True:
        total = len(sectors) + n_fat + n_difat
        need_fat = -(-total // 128)
        need_difat = max(0, -(-(need_fat - 109) // 127))
        if (need_fat, need_difat) == (n_fat, n_difat):
            break
        n_fat, n_difat = need_fat, need_difat
    fat_at = len(sectors)
    fat += [FAT_SECTOR] * n_fat + [DIFAT_SECTOR] * n_difat
    fat += [FREE] * (n_fat * 128 - len(fat))
    raw = struct.pack(f"<{len(fat)}I", *fat)
    sectors += [raw[512 * k : 512 * k + 512] for k in range(n_fat)]
    places = [fat_at + k for k in range(n_fat)]
    rest = places[109:]
    for k in range(n_difat):
        part = rest[127 * k : 127 * k + 127]
        sectors.append(struct.pack("<128I", *part, *[FREE] * (127 - len(part)), fat_at + n_fat + k + 1 if k + 1 < n_difat else END))
    head = SIGNATURE + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, n_fat, dir_start, 0, CUTOFF, mini_start, n_mini, fat_at + n_fat if n_difat else END, n_difat)
    head += struct.pack("<109I", *(places[:109] + [FREE] * (109 - min(109, len(places)))))
    return head + b"".join(sectors)
