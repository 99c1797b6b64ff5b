"""A stretch of records as Arrow arrays, without a Python object for each cell.

Quotes are paired by parity. That is the exact reading as long as each opening quote stands at the
start of a field and each closing one before a comma or a line end; both are checked, and so are
widths and escapes. Where a check fails there is no shape: the record-by-record parser then reads the
stretch and says what is wrong with it, or takes a stray quote as the data that it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..model import Format

#: A separator row of a Markdown table, alone on its line.
MARKDOWN_LINE = re.compile(rb"^(?=.{5,}$)(?=(?:[^-\n]*-){3})\|[|: -]*\|\r?$", re.M)
CHUNK = 4 << 20  # bytes turned into arrays together
PLAIN_NEEDLE = frozenset(b'",\n\r\\')


def paired_quotes(arr: np.ndarray, quotes: np.ndarray, inside: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(opening, closing, which opening ones only double the closing one before them), or None where
    parity is not the exact reading. inside: the stretch starts in a quoted cell, opened at -1."""
    places = np.concatenate([[-1], quotes]) if inside else quotes
    opens, closes = places[0::2], places[1::2]
    again = np.zeros(len(opens), bool)
    again[1:] = opens[1:] == closes[: len(opens) - 1] + 1
    if not len(arr):
        return opens, closes, again
    before = arr[np.maximum(opens - 1, 0)]
    if not (again | (opens <= 0) | (before == 44) | (before == 10)).all():
        return None
    n = len(arr)
    after, second = (arr[np.minimum(closes + k, n - 1)] for k in (1, 2))
    fits = (closes + 1 >= n) | (after == 44) | (after == 10) | (after == 34) | ((after == 13) & (closes + 2 < n) & (second == 10))
    return (opens, closes, again) if fits.all() else None


@dataclass
class Shape:
    """Where the fields and records of a stretch lie."""

    arr: np.ndarray
    format: Format
    quotes: np.ndarray
    doubled: np.ndarray  # quotes that are a cell's own
    starts: np.ndarray  # of each field
    stops: np.ndarray  # of each field, without a line end
    first: np.ndarray  # number of each record's first field, and the number of fields
    ends: np.ndarray  # place of the line feed after each record

    def __len__(self) -> int:
        return len(self.first) - 1

    def lines(self) -> np.ndarray:
        """Line feeds before each record."""
        feeds = np.flatnonzero(self.arr == 10)
        return np.searchsorted(feeds, self.starts[self.first[:-1]])

    def records_at(self, places: np.ndarray) -> np.ndarray:
        """The records that hold these bytes."""
        return np.unique(np.searchsorted(self.ends, places))

    def arrays(self, low: int, high: int) -> tuple[pa.Array, pa.Array]:
        """(fields, raws) of records low to high - 1. raws is null where encoding gives the same bytes."""
        f0, f1 = int(self.first[low]), int(self.first[high])
        base, end = int(self.starts[f0]), int(self.ends[high - 1])
        own = self.arr[base:end]
        a, b = self.starts[f0:f1] - base, self.stops[f0:f1] - base
        keep = np.ones(len(own) + 2, bool)  # but for what lies between two fields: a comma, or a line end of one or two bytes
        keep[b] = False
        keep[b[:-1][a[1:] - b[:-1] == 2] + 1] = False
        keep = keep[: len(own)]
        raw = keep
        q = self.quotes[np.searchsorted(self.quotes, base) : np.searchsorted(self.quotes, end)] - base
        text = own
        if self.format is not Format.LINES:
            keep = keep.copy()
            keep[q] = False
            d = self.doubled[np.searchsorted(self.doubled, base) : np.searchsorted(self.doubled, end)] - base
            keep[d] = True
            if self.format is Format.TWO:
                escapes = _escapes(own)
                if len(escapes):
                    keep[escapes] = False
                    text = own.copy()
                    then = own[escapes + 1]
                    text[escapes[then == 110] + 1] = 10
                    text[escapes[then == 114] + 1] = 13
        lists = (self.first[low : high + 1] - f0).astype(np.int32)
        fields = pa.ListArray.from_arrays(pa.array(lists), _binary(text, keep, a, b))
        if self.format is Format.LINES:
            return fields, pa.nulls(high - low, pa.list_(pa.binary()))
        odd = np.add.reduceat(self._odd(own, keep, a, b), lists[:-1]) > 0 if f1 > f0 else np.zeros(0, bool)
        if not odd.any():
            return fields, pa.nulls(high - low, pa.list_(pa.binary()))
        raws = pa.ListArray.from_arrays(pa.array(lists), _binary(own, raw, a, b))
        return fields, pc.if_else(pa.array(odd), raws, pa.scalar(None, raws.type))

    def _odd(self, own: np.ndarray, keep: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which fields the encoder would write otherwise than they stand here."""
        if not len(own):
            return np.zeros(len(a), np.int32)
        last = len(own) - 1
        quoted = (b > a) & (own[np.minimum(a, last)] == 34)
        two = self.format is Format.TWO
        special = keep & ((own == 44) | (own == 34) | ((own == 10) | (own == 13) if not two else False))
        sums = np.concatenate([[0], np.cumsum(special, dtype=np.int32)])
        ca, cb = a + quoted, b - quoted
        some = cb > ca
        head, tail = own[np.clip(ca, 0, last)], own[np.clip(cb - 1, 0, last)]
        edge = some & ((head == 32) | (head == 9) | (tail == 32) | (tail == 9))
        odd = (((sums[b] - sums[a]) > 0) | edge) != quoted
        if two:  # a carriage return that stands unescaped
            returns = np.concatenate([[0], np.cumsum(own == 13, dtype=np.int32)])
            odd |= returns[b] > returns[a]
        return odd.astype(np.int32)


def _binary(data: np.ndarray, keep: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """The kept bytes of each field; nothing is kept between fields."""
    sums = np.concatenate([[0], np.cumsum(keep, dtype=np.int32)]).astype(np.int32)
    offsets = np.append(sums[a], sums[-1]).astype(np.int32) if len(a) else np.zeros(1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(data[keep])])


def _escapes(arr: np.ndarray) -> np.ndarray:
    """Backslashes that start an escape: every other one of a run."""
    at = np.flatnonzero(arr == 92)
    if not len(at):
        return at
    run = np.concatenate([[True], np.diff(at) != 1])
    begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - begin) % 2 == 0]


def shape_of(data: bytes, format: Format, last: bool = True, width: int | None = None) -> Shape | None:
    """The shape of a stretch that starts at a record, or None where the other parser must look."""
    arr = np.frombuffer(data, np.uint8)
    n = len(arr)
    quotes = doubled = np.empty(0, np.int64)
    feed = arr == 10
    if format is Format.LINES:
        at = np.flatnonzero(feed)
    else:
        at = np.flatnonzero(feed | (arr == 44))
        quotes = np.flatnonzero(arr == 34)
        if len(quotes):
            if len(quotes) % 2 or (pairs := paired_quotes(arr, quotes)) is None:
                return None
            doubled = pairs[0][pairs[2]]
            out = np.searchsorted(quotes, at) % 2 == 0
            if format is Format.TWO and feed[at[~out]].any():
                return None
            at = at[out]
        if format is Format.TWO:
            e = _escapes(arr)
            if len(e) and (e[-1] + 1 >= n or not np.isin(arr[e + 1], (110, 114, 92)).all()):
                return None
    is_end = feed[at] if format is not Format.LINES else np.ones(len(at), bool)
    if n and (not len(at) or at[-1] != n - 1 or not is_end[-1]):  # the last line has no line feed
        if not last or format is Format.TWO or (format is Format.CSV and arr[-1] == 13):
            return None
        at, is_end = np.append(at, n), np.append(is_end, True)
    final = np.flatnonzero(is_end)
    first = np.concatenate([[0], final + 1])
    if width is not None and format is not Format.LINES and (np.diff(first) != width).any():
        return None
    if width == 1 and format is not Format.LINES and b"|" in data and MARKDOWN_LINE.search(data):
        return None
    starts = np.concatenate([[0], at[:-1] + 1]) if len(at) else at
    stops = at.copy()
    ends = at[final]
    if n:
        cut = final[(ends > starts[final]) & (arr[np.maximum(ends - 1, 0)] == 13)]
        stops[cut] -= 1
    return Shape(arr, format, quotes, doubled, starts, stops, first, ends)


def places_of(data: bytes, needle: bytes) -> Iterator[int]:
    at = data.find(needle)
    while at >= 0:
        yield at
        at = data.find(needle, at + 1)


def can_look_ahead(needle: bytes) -> bool:
    """Whether a cell can hold the needle only where the file does: it has no byte that a format writes otherwise."""
    return bool(needle) and not PLAIN_NEEDLE & set(needle)
