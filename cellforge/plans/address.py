"""Addresses as people paste them: record:column, with claims about line and spreadsheet cell."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..model import EngineError
from ..sources.table import Table

_SHAPE = re.compile(r"(\d+):(.+?)(?:@L(\d+))?(?: \[([A-Z]+)(\d+)\])?", re.S)


@dataclass(frozen=True)
class Address:
    record: int
    column: str
    line: int | None = None
    sheet: tuple[str, int] | None = None

    @classmethod
    def parse(cls, text: str) -> Address:
        m = _SHAPE.fullmatch(text)
        if not m or int(m[1]) < 1:
            raise EngineError("invalid-address", f'"{text}" is not record:column', f"「{text}」不是 筆:欄")
        return cls(int(m[1]), m[2], int(m[3]) if m[3] else None, (m[4], int(m[5])) if m[4] else None)

    def checked(self, table: Table) -> tuple[int, int]:
        """(record, column from 0), once every claim holds."""
        column = table.header.resolve(self.column)
        if self.sheet:
            number = 0
            for c in self.sheet[0]:
                number = number * 26 + ord(c) - 64
            if (number, self.sheet[1]) != (column + 1, self.record + len(table.header.rows)):
                raise EngineError("invalid-address", f"the address claims cell {self.sheet[0]}{self.sheet[1]}, which is another", "位址聲稱的試算表儲存格不符")
        if self.line is not None:
            if self.record > table.total():
                raise EngineError("out-of-range", f"there is no record {self.record}", f"沒有第 {self.record} 筆")
            found = table.narrowed(self.record, self.record).df.select("line").take(1)
            if not found or found[0][0] != self.line:
                raise EngineError("invalid-address", f"the address claims line {self.line}, and record {self.record} is not there", "位址聲稱的行號不符")
        return self.record, column


def checked_cell(table: Table, record: int, column: str | int) -> tuple[int, int]:
    """(record, column as a number from 1) of a cell whose column may carry claims, as in `license@L3 [C3]`."""
    at = Address.parse(f"{record}:{column}").checked(table)
    return at[0], at[1] + 1


def parse_range(text: str) -> tuple[int | None, int | None]:
    """`a,b`, `a,` or `,b`, inclusive; a single number is that record."""
    m = re.fullmatch(r"(\d*)(,?)(\d*)", text)
    if not m or not (m[1] or m[3]):
        raise EngineError("usage", f'"{text}" is not a range', f"「{text}」不是範圍")
    low = int(m[1]) if m[1] else None
    high = int(m[3]) if m[3] else None if m[2] else low
    if (low is not None and low < 1) or (high is not None and high < (low or 1)):
        raise EngineError("usage", f'the range "{text}" is empty', f"範圍「{text}」是空的")
    return low, high
