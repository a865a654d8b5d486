"""AES-256-CBC without padding over many independent segments at once, in NumPy.

A segment's blocks depend on each other when encrypting, so the loop is over the blocks of a
segment while all segments advance together; decryption does all blocks at once.
"""

from __future__ import annotations

import numpy as np


def _tables() -> tuple[np.ndarray, np.ndarray]:
    p = q = 1
    box = np.zeros(256, np.uint8)
    while True:
        p ^= (p << 1) ^ (0x11B if p & 0x80 else 0)
        p &= 0xFF
        for s in (1, 2, 4):
            q ^= q << s
        q &= 0xFF
        if q & 0x80:
            q ^= 0x09
        r = q
        for s in (1, 2, 3, 4):
            r ^= ((q << s) | (q >> (8 - s))) & 0xFF
        box[p] = r ^ 0x63
        if p == 1:
            break
    box[0] = 0x63
    inverse = np.zeros(256, np.uint8)
    inverse[box] = np.arange(256)
    return box, inverse


_BOX, _UNBOX = _tables()


def _times(n: int) -> np.ndarray:
    """x * n in the cipher's field, for each x."""
    out = np.zeros(256, np.int64)
    x = np.arange(256)
    while n:
        if n & 1:
            out ^= x
        x = (x << 1) ^ np.where(x & 0x80, 0x11B, 0)
        n >>= 1
    return out.astype(np.uint8)


_M = {n: _times(n) for n in (2, 3, 9, 11, 13, 14)}
# column-major state: byte 4 c + r is row r of column c
_SHIFT = np.array([4 * ((c + r) % 4) + r for c in range(4) for r in range(4)])
_UNSHIFT = np.argsort(_SHIFT)


def round_keys(key: bytes) -> np.ndarray:
    n = len(key) // 4
    words = [list(key[4 * i : 4 * i + 4]) for i in range(n)]
    rcon = 1
    for i in range(n, 4 * (n + 7)):
        t = list(words[-1])
        if i % n == 0:
            t = [int(_BOX[x]) for x in t[1:] + t[:1]]
            t[0] ^= rcon
            rcon = (rcon << 1) ^ (0x11B if rcon & 0x80 else 0)
        elif n > 6 and i % n == 4:
            t = [int(_BOX[x]) for x in t]
        words.append([a ^ b for a, b in zip(words[i - n], t)])
    return np.array(words, np.uint8).reshape(-1, 16)


def encrypt_blocks(state: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """(n, 16) blocks, each encrypted."""
    s = state ^ keys[0]
    for k in keys[1:-1]:
        s = _BOX[s][:, _SHIFT].reshape(-1, 4, 4)
        a, b, c, d = (s[:, :, i] for i in range(4))
        s = np.stack([_M[2][a] ^ _M[3][b] ^ c ^ d, a ^ _M[2][b] ^ _M[3][c] ^ d, a ^ b ^ _M[2][c] ^ _M[3][d], _M[3][a] ^ b ^ c ^ _M[2][d]], 2).reshape(-1, 16) ^ k
    return _BOX[s][:, _SHIFT] ^ keys[-1]


def decrypt_blocks(state: np.ndarray, keys: np.ndarray) -> np.ndarray:
    s = _UNBOX[(state ^ keys[-1])[:, _UNSHIFT]]
    for k in keys[-2:0:-1]:
        s = (s ^ k).reshape(-1, 4, 4)
        a, b, c, d = (s[:, :, i] for i in range(4))
        m = lambda w, x, y, z: _M[14][w] ^ _M[11][x] ^ _M[13][y] ^ _M[9][z]
        s = _UNBOX[np.stack([m(a, b, c, d), m(b, c, d, a), m(c, d, a, b), m(d, a, b, c)], 2).reshape(-1, 16)[:, _UNSHIFT]]
    return s ^ keys[0]


def cbc_encrypt(data: bytes, key: bytes, ivs: np.ndarray, segment: int) -> bytes:
    """data, a multiple of 16 long, in segments each with its own initial vector."""
    keys, blocks = round_keys(key), np.frombuffer(data, np.uint8).reshape(-1, 16)
    out, per = np.empty_like(blocks), segment // 16
    before = ivs.copy()
    for i in range(min(per, len(blocks))):
        at = np.arange(i, len(blocks), per)
        before = encrypt_blocks(blocks[at] ^ before[: len(at)], keys)
        out[at] = before
    return out.tobytes()


def cbc_decrypt(data: bytes, key: bytes, ivs: np.ndarray, segment: int) -> bytes:
    keys, blocks = round_keys(key), np.frombuffer(data, np.uint8).reshape(-1, 16)
    before = np.empty_like(blocks)
    before[1:] = blocks[:-1]
    first = np.arange(0, len(blocks), segment // 16)
    before[first] = ivs[: len(first)]
    return (decrypt_blocks(blocks, keys) ^ before).tobytes()
