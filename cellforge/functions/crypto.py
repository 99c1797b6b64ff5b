"""Column protection: hashes and HMAC as SQL expressions, ChaCha20-Poly1305 (RFC 8439) over Arrow batches."""

from __future__ import annotations

import base64
import hashlib
import hmac
import os
import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import HASH_SALT, ITERATIONS, KEY_LABEL, EngineError


def derive_key(secret: bytes, salt: bytes) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", secret, KEY_LABEL + salt, ITERATIONS, 32)


def hmac_key(secret: bytes) -> bytes:
    return derive_key(secret, HASH_SALT)


def key_id(key: bytes) -> str:
    return hashlib.sha256(key).hexdigest()[:8]


def check_secret(secret: bytes) -> bytes:
    """A secret that may protect new cells."""
    if len(secret) < 16:
        raise EngineError("usage", "the key file is shorter than 16 bytes", "金鑰檔短於 16 位元組")
    if len(set(secret)) == 1:
        raise EngineError("usage", "the key file repeats one byte", "金鑰檔只是同一個位元組的重複")
    return secret


def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)


def hmac_hex(value: Column, key: bytes) -> Column:
    """HMAC-SHA256 out of built-in functions."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), value), 256))), 256)


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint32(n)) | (x >> np.uint32(32 - n))


def chacha20_blocks(key: bytes, nonce: bytes, counter: int, n: int) -> bytes:
    """n blocks of key stream, all lanes at once."""
    state = np.empty((16, n), np.uint32)
    state[:4] = np.frombuffer(b"expand 32-byte k", "<u4")[:, None]
    state[4:12] = np.frombuffer(key, "<u4")[:, None]
    state[12] = np.arange(counter, counter + n, dtype=np.uint64).astype(np.uint32)
    state[13:] = np.frombuffer(nonce, "<u4")[:, None]
    x = state.copy()

    def quarter(a: int, b: int, c: int, d: int) -> None:
        for into, add, turn, by in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
            x[into] += x[add]
            x[turn] = _rotated(x[turn] ^ x[into], by)

    for _ in range(10):
        for k in range(4):
            quarter(k, k + 4, k + 8, k + 12)
        for k in range(4):
            quarter(k, (k + 1) % 4 + 4, (k + 2) % 4 + 8, (k + 3) % 4 + 12)
    return (x + state).T.astype("<u4").tobytes()


def poly1305(key: bytes, message: bytes) -> bytes:
    r = int.from_bytes(key[:16], "little") & 0x0FFFFFFC0FFFFFFC0FFFFFFC0FFFFFFF
    s, total, prime = int.from_bytes(key[16:], "little"), 0, (1 << 130) - 5
    for at in range(0, len(message), 16):
        total = (total + int.from_bytes(message[at : at + 16] + b"\1", "little")) * r % prime
    return ((total + s) & ((1 << 128) - 1)).to_bytes(16, "little")


def _tag(one_time: bytes, aad: bytes, sealed: bytes) -> bytes:
    pad = lambda b: b + b"\0" * (-len(b) % 16)
    return poly1305(one_time, pad(aad) + pad(sealed) + struct.pack("<QQ", len(aad), len(sealed)))


def _xor(stream: bytes, text: bytes) -> bytes:
    return (np.frombuffer(stream[: len(text)], np.uint8) ^ np.frombuffer(text, np.uint8)).tobytes()


def seal(key: bytes, nonce: bytes, plain: bytes, aad: bytes) -> bytes:
    """Cipher text followed by its tag."""
    stream = chacha20_blocks(key, nonce, 0, 1 + -(-len(plain) // 64))
    sealed = _xor(stream[64:], plain)
    return sealed + _tag(stream[:32], aad, sealed)


def unseal(key: bytes, nonce: bytes, sealed: bytes, aad: bytes) -> bytes | None:
    """The plain text, or None where the tag does not fit."""
    body, tag = sealed[:-16], sealed[-16:]
    stream = chacha20_blocks(key, nonce, 0, 1 + -(-len(body) // 64))
    return _xor(stream[64:], body) if hmac.compare_digest(tag, _tag(stream[:32], aad, body)) else None


def encrypt_cell(key: bytes, value: bytes, column: str, nonce: bytes | None = None) -> bytes:
    nonce = nonce or os.urandom(12)
    return base64.b64encode(nonce + seal(key, nonce, value, column.encode()))


def decrypt_cell(key: bytes, cell: bytes, column: str, record: int) -> bytes:
    try:
        blob = base64.b64decode(cell, validate=True)
    except ValueError:
        blob = b""
    if len(blob) < 28:
        raise EngineError("malformed", f"record {record}, column {column}: not a valid encrypted cell", f"第 {record} 筆，欄位 {column}：不是合法的加密儲存格")
    plain = unseal(key, blob[:12], blob[12:], column.encode())
    if plain is None:
        raise EngineError("auth", f"authentication failed at record {record}, column {column}", f"認證失敗，位置在第 {record} 筆、欄位 {column}")
    return plain
