"""Formats, headers, protection markers and the one error type."""

from __future__ import annotations

import base64
import binascii
import json
import re
from dataclasses import dataclass
from enum import Enum

# File suffix and name of the two-header format, as its files and JSON lines carry them.
TWO_HEADER = "csv2"
# Key derivation.
KEY_LABEL = b"csv2-column-encryption-v1"
HASH_SALT = b"csv2-hash"
ITERATIONS = 200_000
TRAVEL = "~cell-refusal~"


class EngineError(ValueError):
    """A refusal. code is stable; both messages say the same."""

    def __init__(self, code: str, message: str, message_zh: str = "") -> None:
        super().__init__(message)
        self.code, self.message, self.message_zh = code, message, message_zh or message

    def __reduce__(self):
        return EngineError, (self.code, self.message, self.message_zh)

    def for_travel(self) -> RuntimeError:
        """The same for a task: its text survives as the error that the driver sees."""
        return RuntimeError(TRAVEL + json.dumps([self.code, self.message, self.message_zh]) + TRAVEL)

    @classmethod
    def arrived(cls, error: BaseException) -> EngineError | None:
        """The refusal that a failed job carries, if any."""
        m = re.search(f"{TRAVEL}(.*?){TRAVEL}", str(error), re.S)
        return cls(*json.loads(m[1])) if m else None

    def to_json(self) -> str:
        return json.dumps({"error": {"code": self.code, "message": self.message, "message_zh": self.message_zh}}, ensure_ascii=False)


class Format(Enum):
    CSV = "csv"
    TWO = TWO_HEADER
    LINES = "lines"

    @property
    def header_rows(self) -> int:
        return {"csv": 1, TWO_HEADER: 2, "lines": 0}[self.value]

    @classmethod
    def of(cls, path: str) -> Format:
        """By the last suffix alone, whatever its case; anything unknown is lines."""
        suffix = path.rpartition("/")[2].rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
        return {"csv": cls.CSV, TWO_HEADER: cls.TWO}.get(suffix, cls.LINES)


@dataclass(frozen=True)
class Marker:
    """What a header name says about its column: kind is enc, hash, hmac or empty."""

    base: str
    kind: str = ""
    key_id: str = ""
    salt: bytes = b""

    @classmethod
    def parse(cls, name: str) -> Marker:
        base, found, rest = name.rpartition(":enc:")
        if found and ":" in rest:
            key_id, _, salt = rest.partition(":")
            try:
                return cls(base, "enc", key_id, base64.b64decode(salt, validate=True))
            except binascii.Error:
                pass
        if name.endswith(":hash"):
            return cls(name[:-5], "hash")
        base, found, rest = name.rpartition(":hmac:")
        return cls(base, "hmac", rest) if found else cls(name)

    def __str__(self) -> str:
        tail = {"enc": f":enc:{self.key_id}:{base64.b64encode(self.salt).decode()}", "hash": ":hash", "hmac": f":hmac:{self.key_id}"}
        return self.base + tail.get(self.kind, "")


def as_text(value: bytes) -> str:
    """For people: text, or the bytes in hex."""
    try:
        return value.decode()
    except UnicodeDecodeError:
        return f"<non-UTF-8: {value.hex(' ')}>"


@dataclass(frozen=True)
class Header:
    """The header rows of a table: none, one, or English and Chinese."""

    rows: tuple[tuple[bytes, ...], ...] = ()
    width: int = 0

    def markers(self, row: int = 0) -> list[Marker]:
        return [Marker.parse(as_text(v)) for v in self.rows[row]] if len(self.rows) > row else [Marker("")] * self.width

    def names(self, language: str = "en") -> list[str]:
        if not self.rows:
            return [str(i + 1) for i in range(self.width)]
        return [m.base for m in self.markers(1 if language == "zh" and len(self.rows) > 1 else 0)]

    def check(self, format: Format) -> None:
        if len(self.rows) < format.header_rows:
            raise EngineError("malformed", f"the file ends before its {format.header_rows} header row(s)", "檔案在標頭列之前就結束了")
        for row in self.rows:
            if len(row) == 1 and row[0].startswith(b"#"):
                raise EngineError("malformed", "the header is a comment line", "標頭是一行註解")
            for v in row:
                text = as_text(v)
                if ":" in text and not Marker.parse(text).kind:
                    raise EngineError("malformed", f'the column name "{text}" holds a colon that marks no protection', f"欄名「{text}」含有不是保護標記的冒號")
        if len(self.rows) == 2:
            if len(self.rows[0]) != len(self.rows[1]):
                raise EngineError("malformed", "the two header rows differ in width", "兩列標頭的寬度不同")
            for i, (a, b) in enumerate(zip(self.markers(0), self.markers(1), strict=True), 1):
                if (a.kind, a.key_id, a.salt) != (b.kind, b.key_id, b.salt):
                    raise EngineError("malformed", f"the header rows disagree on how column {i} is protected", f"兩列標頭對第 {i} 欄的保護說法不一")

    def resolve(self, token: str | int) -> int:
        """Position (from 0) of a column given by number or base name; never a guess."""
        text = str(token)
        named = [i for i, n in enumerate(self.names()) if n == text] if self.rows else []
        number = int(text) - 1 if text.isascii() and text.isdigit() else None
        inside = number is not None and 0 <= number < self.width
        if len(named) > 1 or (named and inside and named[0] != number):
            raise EngineError("ambiguous", f'"{text}" may mean more than one column', f"「{text}」可指不只一欄")
        if named:
            return named[0]
        if inside:
            return number
        if number is not None:
            raise EngineError("out-of-range", f"column {text} is out of range: there are {self.width}", f"第 {text} 欄超出範圍：共 {self.width} 欄")
        some = self.names()[:12]
        more = f" and {self.width - 12} more" if self.width > 12 else ""
        raise EngineError("not-found", f'no column "{text}"; there are: {", ".join(some)}{more}', f"沒有「{text}」這一欄")

    def resolve_list(self, text: str, encrypted_only: bool = False) -> list[int]:
        """A comma list without repeats; `all` means every encrypted column where asked for."""
        if encrypted_only and text == "all":
            found = [i for i, m in enumerate(self.markers()) if m.kind == "enc"]
            if not found:
                raise EngineError("not-found", "no column is encrypted", "沒有加密的欄位")
            return found
        return list(dict.fromkeys(self.resolve(t) for t in text.split(",")))

    def marked(self, column: int, marker: Marker) -> Header:
        """Both rows with another marker on a column, each with its own base name."""
        rows = []
        for r, row in enumerate(self.rows):
            own = self.markers(r)[column]
            rows.append((*row[:column], str(Marker(own.base, marker.kind, marker.key_id, marker.salt)).encode(), *row[column + 1 :]))
        return Header(tuple(rows), self.width)
