"""Bytes to records and back. Strict: nothing that would be a guess is accepted.

Only two states are possible right after a line feed: at the start of a record, or inside a quoted
cell. So any stretch of a file that starts after a line feed can be scanned under both, on its own
machine, and the results chained afterwards: an exact split of quoted CSV, whatever it holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from ..model import EngineError, Format, Header
from .columnar import MARKDOWN_LINE, paired_quotes

_CELL = re.compile(rb'"((?:[^"]|"")*)"(?=,|\Z)|((?!")[^,]*)', re.S)
_ESCAPE = re.compile(rb"\\(.?)", re.S)
_DECODED = {b"n": b"\n", b"r": b"\r", b"\\": b"\\"}


@dataclass
class Record:
    number: int
    line: int
    offset: int
    fields: list[bytes]
    raw: bytes

    def raws(self, format: Format) -> list[bytes] | None:
        """The cells as they stand in the file, or None where encoding gives the same bytes."""
        if format is Format.LINES or encode(self.fields, format)[:-1] == self.raw:
            return None
        return raw_cells(self.raw)


@dataclass
class Spans:
    """Where records end, and how the stretch ends."""

    ends: np.ndarray  # place of each line feed that ends a record
    inside: bool  # it ends inside a quoted cell
    open_at: int = -1
    fault: int = -1  # place of a byte that may not follow a closing quote
    embedded: int = 0  # line feeds inside cells


def record_spans(data: bytes, format: Format, inside: bool = False) -> Spans:
    """Finds record ends. The walk from quote to quote is for stretches with stray quotes or faults."""
    feeds = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    if format is not Format.CSV and format is not Format.TWO:
        return Spans(feeds, False)
    arr = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(arr == 34)
    if (pairs := paired_quotes(arr, quotes, inside)) is not None:
        opens, closes, _ = pairs
        out = np.searchsorted(quotes, feeds) % 2 == inside
        still = len(opens) > len(closes)
        return Spans(feeds[out], still, int(opens[-1]) if still else -1, -1, len(feeds) - int(out.sum()))
    starts, stops, fault = [], [], -1
    at, n = 0, len(data)
    if inside:
        starts.append(-1)
    find = data.find
    while True:
        if not inside:
            q = find(b'"', at)
            if q < 0:
                break
            if q and data[q - 1] not in b",\n":
                at = q + 1
                continue
            starts.append(q)
            at = q + 1
        inside = True
        while (q := find(b'"', at)) >= 0 and data[q + 1 : q + 2] == b'"':
            at = q + 2
        if q < 0:
            break
        stops.append(q)
        inside = False
        at = q + 1
        follows = data[at : at + 2]
        if follows and follows[0] not in b",\n" and not (follows[:1] == b"\r" and (len(follows) == 1 or follows == b"\r\n")):
            fault = at
            break
    open_at = starts[-1] if inside else -1
    if starts:
        before = np.searchsorted(np.array(starts), feeds, "right")
        after = np.searchsorted(np.array([*stops, *([n] if inside else [])]), feeds, "right")
        own = feeds[before == after]
        return Spans(own, inside, open_at, fault, len(feeds) - len(own))
    return Spans(feeds, inside, open_at, fault, 0)


def unescape_two(value: bytes, where: str) -> bytes:
    """The two-header format's escapes; any other is refused."""

    def one(m: re.Match[bytes]) -> bytes:
        if m[1] not in _DECODED:
            raise EngineError("malformed", f"{where}: unknown escape \\{m[1].decode(errors='replace')}", f"{where}：不認得的跳脫")
        return _DECODED[m[1]]

    return _ESCAPE.sub(one, value) if b"\\" in value else value


def raw_cells(row: bytes) -> list[bytes]:
    """The cells of one record's bytes as they stand there; the record has been read before."""
    if b'"' not in row:
        return row.split(b",")
    out, at = [], 0
    while True:
        m = _CELL.match(row, at)
        out.append(m[0])
        if m.end() == len(row):
            return out
        at = m.end() + 1


def cells(row: bytes, format: Format, where: str) -> list[bytes]:
    """The decoded cells of one record's bytes, without its line ending."""
    if format is Format.LINES:
        return [row]
    if b'"' not in row:
        out = row.split(b",")
    else:
        out, at = [], 0
        while True:
            m = _CELL.match(row, at)
            if m is None:
                raise EngineError("malformed", f"{where}: a byte other than a comma or a line end follows a closing quote", f"{where}：結尾引號之後出現了逗號與換行以外的位元組")
            out.append(m[1].replace(b'""', b'"') if m[1] is not None else m[2])
            at = m.end() + 1
            if m.end() == len(row):
                break
    if format is Format.TWO:
        if b"\n" in row:
            raise EngineError("malformed", f"{where}: a raw line feed inside a cell", f"{where}：儲存格內有未跳脫的換行")
        out = [unescape_two(c, where) for c in out]
    return out


def guard(data: bytes) -> int:
    """Length of a UTF-8 byte order mark; refuses UTF-16 and gzip."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        raise EngineError("malformed", "the file is UTF-16; convert it to UTF-8", "檔案是 UTF-16，請先轉成 UTF-8")
    if data[:2] == b"\x1f\x8b":
        raise EngineError("malformed", "the file is compressed with gzip", "檔案是 gzip 壓縮檔")
    return 3 if data[:3] == b"\xef\xbb\xbf" else 0


def check_markdown(fields: list[bytes], number: int, line: int) -> None:
    """A table line of Markdown is no record of a CSV file, whatever the width."""
    if len(fields) == 1 and MARKDOWN_LINE.fullmatch(fields[0]):
        raise EngineError("malformed", f"record {number} (line {line}) is a Markdown table line inside a CSV file", f"第 {number} 筆是 CSV 檔裡的 Markdown 表格行")


def check_width(fields: list[bytes], width: int, number: int, line: int) -> None:
    if len(fields) == width:
        return
    where = f"record {number} (line {line})"
    if fields == [b""]:
        raise EngineError("ragged", f"{where} is a blank line", f"第 {number} 筆（第 {line} 行）是空行")
    if len(fields) == 1 and fields[0].startswith(b"#"):
        raise EngineError("ragged", f"{where} is a comment line; comments are not skipped", f"第 {number} 筆（第 {line} 行）是註解行")
    raise EngineError("ragged", f"{where} has {len(fields)} fields where {width} are expected", f"第 {number} 筆（第 {line} 行）有 {len(fields)} 欄，應為 {width} 欄")


def parse_stretch(data: bytes, format: Format, *, number: int = 1, line: int = 1, offset: int = 0, last: bool = True, headers: int = 0, truncate: bool = False, ended: bool = True) -> Iterator[Record]:
    """Records of a stretch that starts at a record. number: of the first; up to `headers` records
    count as header rows (numbers below 1). last: the stretch reaches the end of the file."""
    spans = record_spans(data, format)
    start = 0
    arr = np.frombuffer(data, np.uint8)
    lines_before = np.cumsum(np.concatenate([[0], arr == 10])) if spans.embedded else None

    def make(a: int, b: int, no: int) -> Record:
        row = data[a:b]
        at = line + int(lines_before[a]) if lines_before is not None else line + no - number
        if row.endswith(b"\r"):
            row = row[:-1]
        where = f"header row {no - number + 1}" if no < 1 else f"record {no} (line {at})"
        if no < 1 and b"\r" in row and format is not Format.LINES and b'"' not in row:
            raise EngineError("malformed", f"{where}: lone carriage returns; this looks like a file with CR line endings", f"{where}：只有 CR 的換行")
        return Record(no, at, offset + a, cells(row, format, where), row)

    no = number
    stop = spans.fault if spans.fault >= 0 else len(data)
    for end in spans.ends.tolist():
        if end > stop:
            break
        yield make(start, end, no)
        no += 1
        start = end + 1
    if spans.fault >= 0:
        raise EngineError("malformed", f"record {no} (line {line + no - number}): a byte other than a comma or a line end follows a closing quote", f"第 {no} 筆：結尾引號之後出現了逗號與換行以外的位元組")
    if not last or start >= len(data):
        return
    if spans.inside:
        if truncate:
            return
        raise EngineError("malformed", f"record {no}: the file ends inside a quoted cell", f"第 {no} 筆：檔案在引號內結束")
    if format is Format.TWO:
        if truncate:
            return
        raise EngineError("malformed", f"record {no}: the last line has no line feed; the file was cut while being appended to", f"第 {no} 筆：最後一行沒有換行，附加時被截斷")
    if data.endswith(b"\r") and format is not Format.LINES:
        raise EngineError("malformed", "the file ends in a lone carriage return", "檔案以單獨的 CR 結尾")
    yield make(start, len(data), no)


def parse(data: bytes, format: Format, headers: int | None = None, truncate: bool = False, widths: bool = True) -> tuple[Header, list[Record]]:
    """A whole table in memory: its header and its records."""
    headers = format.header_rows if headers is None else headers
    skip = guard(data)
    rows = list(parse_stretch(data[skip:], format, number=1 - headers, offset=skip, truncate=truncate))
    head, rows = rows[:headers], rows[headers:]
    width = len(head[0].fields) if head else len(rows[0].fields) if rows else 0
    header = Header(tuple(tuple(r.fields) for r in head), width)
    if headers:
        header.check(Format.TWO if headers == 2 else Format.CSV)
    for r in rows:
        if format is not Format.LINES:
            check_markdown(r.fields, r.number, r.line)
        if widths:
            check_width(r.fields, width, r.number, r.line)
    return header, rows


def encode_cell(value: bytes, format: Format) -> bytes:
    if format is Format.LINES:
        if b"\n" in value:
            raise EngineError("malformed", "a line cannot hold a line feed", "一行不能含有換行")
        return value
    if format is Format.TWO:
        value = value.replace(b"\\", b"\\\\").replace(b"\n", b"\\n").replace(b"\r", b"\\r")
    quote = any(c in value for c in (b",", b'"', b"\n", b"\r")) or value[:1] in (b" ", b"\t") or value[-1:] in (b" ", b"\t")
    return b'"' + value.replace(b'"', b'""') + b'"' if quote else value


def encode(fields: list[bytes], format: Format) -> bytes:
    """One record with its line feed."""
    return b",".join(encode_cell(v, format) for v in fields) + b"\n"
