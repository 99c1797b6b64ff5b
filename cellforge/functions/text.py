"""Escapes and widths of text output."""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import EngineError, as_text

_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
_NAMED = {"\t": "\\t", "\n": "\\n", "\r": "\\r"}


def report_escape(value: bytes, most: int = 200) -> str:
    """One line for one cell: at most `most` characters, then how many more there are."""
    text = as_text(value)
    more = f"…[+{len(text) - most} more chars]" if len(text) > most else ""
    text = text[:most].replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: _NAMED.get(m[0]) or f"\\x{ord(m[0]):02X}", text) + more


def json_string(value: bytes, ascii_only: bool = False, where: str = "") -> str:
    """A JSON string; bytes that are not UTF-8 are refused, never replaced."""
    try:
        text = value.decode()
    except UnicodeDecodeError:
        raise EngineError("malformed", f"{where} is not valid UTF-8, and JSON is text", f"{where}不是合法的 UTF-8") from None
    out = json.dumps(text, ensure_ascii=ascii_only).replace("\\b", "\\u0008").replace("\\f", "\\u000c") if "\b" in text or "\f" in text else json.dumps(text, ensure_ascii=ascii_only)
    return out.replace("\x7f", "\\u007f") if ascii_only else out


def markdown_cell(value: bytes) -> str:
    """A table cell that reads back to the same bytes."""
    text = value.decode(errors="replace").replace("\\", "\\\\").replace("|", "\\|").replace("<br>", "\\<br>").replace("\n", "<br>")
    text = _CONTROL.sub(lambda m: "\\t" if m[0] == "\t" else f"\\x{ord(m[0]):02X}", text)
    if text.startswith(" "):
        text = "\\x20" + text[1:]
    if text.endswith(" "):
        text = text[:-1] + "\\x20"
    if re.fullmatch(r"[-:]*-[-:]*", text.strip()):  # would look like a separator
        text = re.sub(r"[-:]", lambda m: f"\\x{ord(m[0]):02X}", text, count=1)
    return text


def markdown_cell_column(value: Column) -> Column:
    """markdown_cell by built-in functions."""
    text = F.make_valid_utf8(value.cast("string"))
    for a, b in (("\\", "\\\\"), ("|", "\\|"), ("<br>", "\\<br>"), ("\n", "<br>"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    every = text
    for c in (*range(0x20), 0x7F):
        if c not in (9, 10):
            every = F.replace(every, F.lit(chr(c)), F.lit(f"\\x{c:02X}"))
    text = F.when(text.rlike(r"[\x00-\x1f\x7f]"), every).otherwise(text)
    text = F.when(text.startswith(" "), F.concat(F.lit("\\x20"), F.substring(text, 2, 2**31 - 1))).otherwise(text)
    text = F.when(text.endswith(" "), F.concat(F.left(text, F.length(text) - 1), F.lit("\\x20"))).otherwise(text)
    first = F.when(text.startswith("-"), "\\x2D").otherwise("\\x3A")
    return F.when(text.rlike(r"^[-:]*-[-:]*\z"), F.concat(first, F.substring(text, 2, 2**31 - 1))).otherwise(text)


_UNESCAPED = {"\\": "\\", "|": "|", "t": "\t", "<br>": "<br>"}


def markdown_unescape(cell: str) -> bytes:
    out, at = bytearray(), 0
    for m in re.finditer(r"\\(\\|\||t|<br>|x[0-9A-Fa-f]{2})|<br>|\\(.)", cell, re.S):
        out += cell[at : m.start()].encode()
        if m[2] is not None:
            raise EngineError("malformed", f"a Markdown cell contains the escape \\{m[2]}, which is never written", f"Markdown 儲存格含有不會寫出的跳脫 \\{m[2]}")
        if m[0] == "<br>":
            out += b"\n"
        elif m[1][0] == "x":
            out.append(int(m[1][1:], 16))
        else:
            out += _UNESCAPED[m[1]].encode()
        at = m.end()
    return bytes(out) + cell[at:].encode()


def display_width(text: str) -> int:
    """Columns on a terminal: wide and full-width count two, combining and control none; in a cluster the widest counts."""
    import regex

    def one(c: str) -> int:
        if unicodedata.category(c) in ("Mn", "Me", "Cf", "Cc"):
            return 0
        return 2 if unicodedata.east_asian_width(c) in "WF" else 1

    total = 0
    for cluster in regex.findall(r"\X", text):
        width = max(map(one, cluster))
        if "\ufe0f" in cluster or "\u20e3" in cluster:
            width = 2
        total += width
    return total
