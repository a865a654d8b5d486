"""Password-protected packages: agile encryption, AES-256-CBC with SHA-512."""

from __future__ import annotations

import base64
import hashlib
import hmac
import os
import struct
from xml.etree import ElementTree

import numpy as np

from .aes import cbc_decrypt, cbc_encrypt
from .compound import is_compound, read_streams, write_streams
from .package import local

SPINS, SEGMENT = 100_000, 4096
_INPUT, _VALUE, _KEY = bytes.fromhex("fea7d2763b4b9e79"), bytes.fromhex("d7aa0f6d3061344e"), bytes.fromhex("146e0be7abacd0d6")
_MAC_KEY, _MAC_VALUE = bytes.fromhex("5fb2ad010cb9e1f6"), bytes.fromhex("a0677f02b22c8433")


class PasswordError(ValueError):
    """The password is missing or wrong, or the content was tampered with."""


def _sha(*parts: bytes) -> bytes:
    return hashlib.sha512(b"".join(parts)).digest()


def _hash(password: str, salt: bytes, spins: int) -> bytes:
    h = _sha(salt, password.encode("utf-16-le"))
    for i in range(spins):
        h = hashlib.sha512(struct.pack("<I", i) + h).digest()
    return h


def _one(run, data: bytes, key: bytes, iv: bytes) -> bytes:
    data = data.ljust(-(-len(data) // 16) * 16, b"\0")
    return run(data, key, np.frombuffer(iv[:16], np.uint8).reshape(1, 16), max(16, len(data)))


def _ivs(salt: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(_sha(salt, struct.pack("<I", i))[:16] for i in range(n)), np.uint8).reshape(-1, 16)


def is_encrypted(data: bytes) -> bool:
    return is_compound(data)


def encrypt(package: bytes, password: str, *, spins: int = SPINS) -> bytes:
    """The package as an encrypted compound file."""
    if not password:
        raise PasswordError("a password is needed")
    salt, key_salt, key = os.urandom(16), os.urandom(16), os.urandom(32)
    h = _hash(password, salt, spins)
    verifier = os.urandom(16)
    wrap = lambda block, data: _one(cbc_encrypt, data, _sha(h, block)[:32], salt)
    padded = package.ljust(-(-len(package) // 16) * 16, b"\0")
    body = struct.pack("<Q", len(package)) + (cbc_encrypt(padded, key, _ivs(key_salt, -(-len(padded) // SEGMENT)), SEGMENT) if padded else b"")
    mac_key = os.urandom(64)
    mac = hmac.digest(mac_key, body, "sha512")
    b64 = lambda x: base64.b64encode(x).decode()
    cipher = 'blockSize="16" keyBits="256" hashSize="64" cipherAlgorithm="AES" cipherChaining="ChainingModeCBC" hashAlgorithm="SHA512"'
    info = (
        '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><encryption xmlns="http://schemas.microsoft.com/office/2006/encryption" xmlns:p="http://schemas.microsoft.com/office/2006/keyEncryptor/password">'
        f'<keyData saltSize="16" {cipher} saltValue="{b64(key_salt)}"/>'
        f'<dataIntegrity encryptedHmacKey="{b64(_one(cbc_encrypt, mac_key, key, _sha(key_salt, _MAC_KEY)))}" encryptedHmacValue="{b64(_one(cbc_encrypt, mac, key, _sha(key_salt, _MAC_VALUE)))}"/>'
        f'<keyEncryptors><keyEncryptor uri="http://schemas.microsoft.com/office/2006/keyEncryptor/password"><p:encryptedKey spinCount="{spins}" saltSize="16" {cipher} saltValue="{b64(salt)}"'
        f' encryptedVerifierHashInput="{b64(wrap(_INPUT, verifier))}" encryptedVerifierHashValue="{b64(wrap(_VALUE, _sha(verifier)))}" encryptedKeyValue="{b64(wrap(_KEY, key))}"/></keyEncryptor></keyEncryptors></encryption>'
    )
    return write_streams({"EncryptionInfo": struct.pack("<HHI", 4, 4, 0x40) + info.encode(), "EncryptedPackage": body} | _data_spaces())


def decrypt(data: bytes, password: str | None) -> bytes:
    """The package inside an encrypted compound file; its authentication code is checked first."""
    if not password:
        raise PasswordError("the file is encrypted: a password is needed")
    streams = read_streams(data)
    if "EncryptionInfo" not in streams or "EncryptedPackage" not in streams:
        raise ValueError("the compound file holds no encrypted package")
    root = ElementTree.fromstring(streams["EncryptionInfo"][8:])
    nodes = {local(e.tag): e for e in root.iter()}
    get = lambda e, k: base64.b64decode(nodes[e].get(k, ""))
    e = nodes["encryptedKey"]
    salt, spins = get("encryptedKey", "saltValue"), int(e.get("spinCount", 0))
    if not 0 <= spins <= 10_000_000 or e.get("hashAlgorithm") != "SHA512":
        raise ValueError("the encryption's parameters aren't supported")
    h = _hash(password, salt, spins)
    unwrap = lambda block, k: _one(cbc_decrypt, get("encryptedKey", k), _sha(h, block)[:32], salt)
    if not hmac.compare_digest(_sha(unwrap(_INPUT, "encryptedVerifierHashInput")[:16]), unwrap(_VALUE, "encryptedVerifierHashValue")[:64]):
        raise PasswordError("the password is wrong")
    key, key_salt, body = unwrap(_KEY, "encryptedKeyValue")[:32], get("keyData", "saltValue"), streams["EncryptedPackage"]
    if "dataIntegrity" in nodes:
        mac_key = _one(cbc_decrypt, get("dataIntegrity", "encryptedHmacKey"), key, _sha(key_salt, _MAC_KEY))[:64]
        mac = _one(cbc_decrypt, get("dataIntegrity", "encryptedHmacValue"), key, _sha(key_salt, _MAC_VALUE))[:64]
        if not hmac.compare_digest(hmac.digest(mac_key, body, "sha512"), mac):
            raise PasswordError("the content was tampered with")
    length, = struct.unpack_from("<Q", body)
    cipher = body[8 : 8 + (len(body) - 8) // 16 * 16]
    if length > len(cipher):
        raise ValueError("the encrypted package is cut off")
    return cbc_decrypt(cipher, key, _ivs(key_salt, -(-len(cipher) // SEGMENT)), SEGMENT)[:length] if cipher else b""


def _data_spaces() -> dict[str, bytes]:
    """The fixed streams that name the transform."""

    def text(s: str) -> bytes:
        raw = s.encode("utf-16-le")
        return struct.pack("<I", len(raw)) + raw + bytes(-len(raw) % 4)

    version = text("Microsoft.Container.DataSpaces") + struct.pack("<HHHHHH", 1, 0, 1, 0, 1, 0)
    entry = struct.pack("<II", 1, 0) + text("EncryptedPackage") + text("StrongEncryptionDataSpace")
    space_map = struct.pack("<II", 8, 1) + struct.pack("<I", len(entry) + 4) + entry
    space = struct.pack("<II", 8, 1) + text("StrongEncryptionTransform")
    name = text("{FF9A3F03-56EF-4613-BDD5-5A41C1D07246}")
    transform = struct.pack("<II", 8 + len(name), 1) + name + text("Microsoft.Container.EncryptionTransform") + struct.pack("<HHHHHH", 1, 0, 1, 0, 1, 0) + struct.pack("<IIII", 0, 0, 0, 4)
    base = "\x06DataSpaces/"
    return {base + "Version": version, base + "DataSpaceMap": space_map, base + "DataSpaceInfo/StrongEncryptionDataSpace": space, base + "TransformInfo/StrongEncryptionTransform/\x06Primary": transform}
