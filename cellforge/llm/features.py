"""Hashed character and word features of whole texts, vectorised with numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

WINDOW = 1 << 18  # characters looked at together; the features do not depend on it
_M = np.uint32
_BLANK = np.zeros(0x10000, bool)
_BLANK[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
_OTHER = np.array([not chr(c).isalpha() for c in range(0x300)])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _spread(h: np.ndarray, size: int) -> np.ndarray:
    h = (h ^ (h >> _M(15))) * _M(0x2C1B3C6D)
    return (h ^ (h >> _M(13))) & _M(size - 1)


def letter_gram_counts(text: str, size: int, longest: int = 3) -> np.ndarray:
    """Counts of lower-cased character n-grams, 1 to longest, in `size` (a power of two) hash
    buckets. Runs of anything but letters count as one blank; texts are padded with a blank."""
    total = np.zeros(size, np.int64)
    text = text.lower()
    held = np.empty(0, np.uint32)  # the characters before the window that n-grams reach back to
    for low in range(0, len(text), WINDOW):
        c = code_points(text[low : low + WINDOW])
        odd = _OTHER[np.minimum(c, 0x2FF)] & (c < 0x300)
        c = np.where(odd, _M(32), c).astype(np.uint32)
        c = np.concatenate([held if low else [_M(32)], c, [_M(32)] if low + WINDOW >= len(text) else []]).astype(np.uint32)
        old = len(held)
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
        c = c[keep]  # held has no two blanks in a row: it keeps its length
        h = c * _M(0x9E3779B1)
        total += np.bincount(_spread(h[old:], size), minlength=size)
        for n in range(2, longest + 1):
            if len(c) >= n:
                h = (h[:-1] ^ (h[:-1] >> _M(16))) * _M(0x85EBCA6B) + c[n - 1 :] * _M(0xC2B2AE35) + _M(n)
                total += np.bincount(_spread(h[max(0, old - n + 1) :], size), minlength=size)
        held = c[-(longest - 1) :] if longest > 1 else c[-1:]
    return total


_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _windows(text: str) -> Iterator[str]:
    """text in windows that end at a blank, so that no word is cut."""
    low = 0
    while low < len(text):
        end = low + WINDOW
        if end < len(text):
            blank = _BLANKS.search(text, end - 1)
            end = blank.end() if blank else len(text)
        yield text[low:end]
        low = end


def subword_features(text: str, size: int) -> np.ndarray:
    """Bucket of every word, pair of neighbouring words and character 3- and 5-gram inside words with their
    bounds (case kept). A word that repeats its predecessor makes one fixed pair."""
    found = []
    before = np.empty(0, np.uint32)  # the last word of the window before
    for window in _windows(text):
        c = np.concatenate([[_M(32)], code_points(window), [_M(32)]]).astype(np.uint32)
        blank = _BLANK[np.minimum(c, 0xFFFF)] & (c < 0x10000)
        c = np.where(blank, _M(32), c)
        first = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
        if not len(first):
            continue
        last = np.flatnonzero(~blank[:-1] & blank[1:])
        mixed = (c ^ (c << _M(7))) * _M(0x9E3779B1)
        place = np.arange(len(c), dtype=np.uint32)
        place -= np.repeat(np.concatenate([[_M(0)], first.astype(np.uint32)]), np.diff(np.concatenate([[0], first, [len(c)]])))
        sums = np.cumsum(mixed * (place * _M(0x27D4EB2F) | _M(1)), dtype=np.uint32)
        word = sums[last] - sums[first - 1]
        found.append(_spread(word ^ _M(0x51ED270B), size))
        word = np.concatenate([before, word])
        before = word[-1:]
        pair = np.where(word[1:] == word[:-1], _M(0x1234567), word[1:] * _M(0x165667B1) ^ word[:-1])
        found.append(_spread(pair ^ _M(0x3C6EF372), size))
        h = (mixed[:-2] * _M(0x85EBCA6B) ^ mixed[1:-1]) * _M(0xC2B2AE35) ^ mixed[2:]
        found.append(_spread(h, size)[~blank[1:-1]])
        if len(c) >= 5:
            h = (h[:-2] * _M(0x85EBCA6B) ^ mixed[3:-1]) * _M(0xC2B2AE35) ^ mixed[4:]
            found.append(_spread(h ^ _M(0x68E31DA4), size)[~(blank[1:-3] | blank[2:-2] | blank[3:-1])])
    return np.concatenate(found) if found else np.empty(0, np.uint32)
