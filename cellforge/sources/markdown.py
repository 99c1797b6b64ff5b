"""Markdown tables: reading one out of a document, writing one, and editing one in place. Bounded input."""

from __future__ import annotations

import re
from collections import defaultdict, deque
from dataclasses import dataclass

from ..functions.text import display_width, markdown_cell, markdown_unescape
from ..model import EngineError, Format, Header

MOST_BYTES = 16 << 20
_SEPARATOR = re.compile(r":?-+:?")


@dataclass
class Place:
    header: int  # line of the table's header
    end: int  # line after its last row


def split_row(line: str) -> list[str]:
    """Cells between unescaped bars."""
    cells = [c.strip() for c in re.findall(r"((?:\\.|[^|\\]|\\$)*)(?:\||$)", line, re.S)[:-1]] if line.rstrip().endswith("|") else [c.strip() for c in re.findall(r"((?:\\.|[^|\\]|\\$)*)(?:\||$)", line, re.S)]
    while len(cells) > 1 and cells[-1] == "" and not line.rstrip().endswith("|"):
        cells.pop()
    return cells[1:] if cells and cells[0] == "" else cells


def is_separator(line: str) -> bool:
    cells = split_row(line)
    return bool(cells) and all(_SEPARATOR.fullmatch(c) for c in cells)


def find_tables(lines: list[str]) -> list[Place]:
    out, i = [], 0
    while i + 1 < len(lines):
        if lines[i].strip().startswith("|") and not is_separator(lines[i]) and is_separator(lines[i + 1]):
            end = i + 2
            while end < len(lines) and lines[end].strip().startswith("|"):
                if is_separator(lines[end]):
                    end = end - 1 if end > i + 2 else end
                    break
                end += 1
            out.append(Place(i, end))
            i = end
        else:
            i += 1
    return out


def read_markdown(data: bytes, number: int | None = None, most: int = MOST_BYTES) -> tuple[Header, list[list[bytes]], Format, Place, list[str]]:
    """(header, rows, format, place, lines). Without a number the document must be one table and nothing else."""
    if len(data) > most:
        raise EngineError("too-large", f"the document is larger than {most} bytes", f"文件大於 {most} 位元組")
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        raise EngineError("malformed", "the document is not UTF-8", "文件不是 UTF-8") from None
    lines = [x.removesuffix("\r") for x in text.split("\n")]
    tables = find_tables(lines)
    if not tables:
        raise EngineError("malformed", "the document holds no table", "文件裡沒有表格")
    if number is None:
        rest = lines[: tables[0].header] + lines[tables[0].end :]
        if len(tables) > 1 or any(x.strip() for x in rest):
            raise EngineError("usage", f"the document holds {len(tables)} table(s) and other text: say which with --md-table", "文件裡不只一個表格，請用 --md-table 指定")
        number = 1
    if not 1 <= number <= len(tables):
        raise EngineError("out-of-range", f"there is no table {number}: there are {len(tables)}", f"沒有第 {number} 個表格")
    place = tables[number - 1]
    titles = [re.split(r"(?<!\\)<br>", c) for c in split_row(lines[place.header])]
    kinds = {len(t) for t in titles}
    if kinds not in ({1}, {2}):
        raise EngineError("malformed", "the header cells mix one, two or more titles", "標頭儲存格的標題數不一致")
    n = kinds.pop()
    header = Header(tuple(tuple(markdown_unescape(t[k]) for t in titles) for k in range(n)), len(titles))
    rows = []
    for at in range(place.header + 2, place.end):
        row = [markdown_unescape(c) for c in split_row(lines[at])]
        if len(row) != header.width:
            raise EngineError("ragged", f"line {at + 1} has {len(row)} cells where {header.width} are expected", f"第 {at + 1} 行有 {len(row)} 格，應為 {header.width} 格")
        rows.append(row)
    format = Format.TWO if n == 2 else Format.CSV
    header.check(format)
    return header, rows, format, place, lines


def header_cells(header: Header, language: str | None = None, rownum: bool = False) -> list[str]:
    """Titles: of one language, or both in one cell."""
    rows = header.rows if language is None or len(header.rows) < 2 else [header.rows[language == "zh"]]
    if not header.rows:
        raise EngineError("usage", "a Markdown table needs a header row to name its columns", "Markdown 表格需要標頭列為欄位命名")
    names = ["<br>".join(markdown_cell(row[i]) for row in rows) for i in range(header.width)]
    number = ["rownum", "列號"]
    return [*(["列號" if language == "zh" else "<br>".join(number[: len(rows)])] if rownum else []), *names]


def compact_row(cells: list[str]) -> str:
    return "|" + "|".join(cells) + "|"


def compact_header(cells: list[str]) -> list[str]:
    return [compact_row(cells), compact_row(["---"] * len(cells))]


def compact(header: Header, rows: list[list[bytes]]) -> list[str]:
    return [*compact_header(header_cells(header)), *(compact_row([markdown_cell(v) for v in r]) for r in rows)]


def pretty(head: list[str], rows: list[list[str]], most: int = MOST_BYTES) -> list[str]:
    """Columns padded by display width; larger tables are refused, since all widths must be known first."""
    if sum(len(c.encode()) for r in rows for c in r) > most:
        raise EngineError("too-large", f"--pretty holds {most} bytes of cells at most", f"--pretty 最多容納 {most} 位元組")
    wide = [max(3, *(display_width(r[i]) for r in [head, *rows])) for i in range(len(head))]
    line = lambda r: "| " + " | ".join(c + " " * (w - display_width(c)) for c, w in zip(r, wide, strict=True)) + " |"
    return [line(head), "|" + "|".join("-" * (w + 2) for w in wide) + "|", *map(line, rows)]


@dataclass
class Layout:
    """The lines that a table arrived on. A row of the same cells goes out as the line it came in on, each
    line once, in their order; a header of the same titles keeps its line and its separator."""

    header: dict[tuple[str, ...], str]
    separator: str
    rows: dict[tuple[str, ...], deque[str]]

    @classmethod
    def of(cls, lines: list[str], place: Place) -> Layout:
        rows: dict[tuple[str, ...], deque[str]] = defaultdict(deque)
        for line in lines[place.header + 2 : place.end]:
            rows[tuple(markdown_cell(markdown_unescape(c)) for c in split_row(line))].append(line)
        titles = tuple("<br>".join(markdown_cell(markdown_unescape(t)) for t in re.split(r"(?<!\\)<br>", c)) for c in split_row(lines[place.header]))
        return cls({titles: lines[place.header]}, lines[place.header + 1], rows)

    def head(self, cells: list[str]) -> list[str]:
        old = self.header.get(tuple(cells))
        return compact_header(cells) if old is None else [old, self.separator]

    def row(self, cells: list[str]) -> str:
        old = self.rows.get(tuple(cells))
        return old.popleft() if old else compact_row(cells)


def preserved(header: Header, rows: list[list[bytes]], lines: list[str], place: Place) -> list[str]:
    """Compact lines, but for what the document already has the same."""
    layout = Layout.of(lines, place)
    return [*layout.head(header_cells(header)), *(layout.row([markdown_cell(v) for v in r]) for r in rows)]


def replace_table(data: bytes, number: int, header: Header, rows: list[list[bytes]]) -> bytes:
    """The document with its table replaced; a byte order mark, line ends and all other text stay."""
    _, _, _, place, lines = read_markdown(data, number)
    bom = b"\xef\xbb\xbf" if data.startswith(b"\xef\xbb\xbf") else b""
    feed = "\r\n" if b"\r\n" in data else "\n"
    return bom + feed.join([*lines[: place.header], *preserved(header, rows, lines, place), *lines[place.end :]]).encode()
