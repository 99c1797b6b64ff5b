"""Word shingles of byte buffers, vectorised with numpy.

A word's hash joins two polynomials modulo the prime 2^31 - 1, at two random places: 62 bits, of which
two given words of L bytes agree in all with a chance of (L / 2^31)^2. A prime, because modulo a power
of two some words collide whatever the base.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18  # bytes hashed at a time
_U = np.uint64
_rng = np.random.default_rng(0x5EED)
_PRIME = _U(2**31 - 1)
_BYTE = _rng.integers(1, 2**31 - 1, (2, 256), dtype=np.uint64)
_BYTE[:, 65:91] = _BYTE[:, 97:123]  # A-Z hash as a-z
_BASE = [int(x) for x in _rng.integers(2**20, 2**31 - 2, 2)]
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_PLACE = _rng.integers(1, 2**63, 8, dtype=np.uint64) * _U(2) + _U(1)
_STEP = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, for x below 2^62."""
    x = (x & _PRIME) + (x >> _U(31))
    x = (x & _PRIME) + (x >> _U(31))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _power_table(base: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^31 - 1."""
    if base not in _powers:
        table = np.ones(1, np.uint64)
        while len(table) < PIECE + 1:
            table = np.concatenate([table, _reduced(table * _U(pow(base, len(table), 2**31 - 1)))])
        _powers[base] = table[: PIECE + 1]
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


def words_of(data: np.ndarray, begins: np.ndarray, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, last byte) of each word in data, PIECE bytes at most; begins: where documents start."""
    inside = ~separator[data]
    after = np.empty(len(data), bool)  # a word may start here
    after[0] = True
    np.logical_not(inside[:-1], out=after[1:])
    after[begins[begins < len(data)]] = True
    first = np.flatnonzero(inside & after)
    ends = np.empty(len(data), bool)
    ends[-1] = True
    ends[:-1] = after[1:] | ~inside[1:]
    last = np.flatnonzero(inside & ends)
    both = np.zeros(len(first), np.uint64)
    for byte, base in zip(_BYTE, _BASE, strict=True):
        sums = np.cumsum(_reduced(byte[data] * _power_table(base)[: len(data)]))  # below 2^49
        h = _reduced(sums[last] - np.where(first > 0, sums[first - 1], _U(0)))
        h = _reduced(h * _power_table(pow(base, -1, 2**31 - 1))[first])
        both = (both << _U(31)) | h
    return mix(mix(both) + (last - first).astype(np.uint64)), first, last


def _long_word(data: np.ndarray, low: int, high: int) -> tuple[np.ndarray, int]:
    """(hash, end) of the one word that starts at low and fills PIECE bytes or more: the hashes of its
    parts, cut from its own start, folded in order. A word of PIECE bytes at most has its usual hash."""
    folded = None
    while low < high and not _SEPARATOR[data[low]]:
        cut = np.flatnonzero(_SEPARATOR[data[low : min(low + PIECE, high)]])
        end = low + int(cut[0]) if cut.size else min(low + PIECE, high)
        part = words_of(data[low:end], np.zeros(1, np.int64))[0]
        folded = part if folded is None else mix(folded * _U(_STEP) + part)
        low = end
    return folded, low


def word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text (null: none) the hashes of its words, A-Z as a-z."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        low, high = int(offsets[i]), int(offsets[j])
        if high == low:
            for _ in range(i, j):
                yield np.empty(0, np.uint64)
        elif high - low <= PIECE:
            hashes, first, _ = words_of(data[low:high], offsets[i:j] - low)
            cuts = np.searchsorted(first, offsets[i : j + 1] - low)
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield hashes[a:b]
        else:  # one long text, in parts that end at a separator
            parts = []
            while low < high:
                end = min(low + PIECE, high)
                if end < high:
                    cut = np.flatnonzero(_SEPARATOR[data[low:end]])
                    if not cut.size:
                        long, low = _long_word(data, low, high)
                        parts.append(long)
                        continue
                    end = low + int(cut[-1]) + 1
                parts.append(words_of(data[low:end], np.zeros(1, np.int64))[0])
                low = end
            yield np.concatenate(parts)
        i = j


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of runs of `width` words; fewer words: all of them as one."""
    n = len(words)
    if n == 0:
        return words
    if n < width:
        return mix(np.concatenate([words * _PLACE[:n], np.array([n], np.uint64) * _PLACE[7]]).sum(keepdims=True))
    out = words[: n - width + 1] * _PLACE[0]
    for k in range(1, width):
        out = out + words[k : n - width + 1 + k] * _PLACE[k]
    return np.unique(mix(out))
