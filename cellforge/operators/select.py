"""Search, windows of records, context and their output shapes, as DataFrames."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import json_string, report_escape
from ..model import TRAVEL, EngineError, Marker
from ..sources.table import Table

JSON_NAMED = {9: "\\t", 10: "\\n", 13: "\\r"}


@dataclass(frozen=True)
class Scope:
    """Where a search looks: everywhere, one record, one column, or one cell."""

    record: int | None = None
    column: str | int | None = None


@F.pandas_udf(T.BinaryType())
def nfc(values: pd.Series) -> pd.Series:
    """NFC of UTF-8 text; other bytes unchanged."""

    def one(v: bytes) -> bytes:
        try:
            return unicodedata.normalize("NFC", v.decode()).encode()
        except UnicodeDecodeError:
            return bytes(v)

    return values.map(one, na_action="ignore")


def _needle(text: str | bytes, normalize: bool) -> bytes:
    raw = text if isinstance(text, bytes) else text.encode()
    if not raw:
        raise EngineError("usage", "an empty search string matches everything", "空的搜尋字串會符合一切")
    return unicodedata.normalize("NFC", raw.decode()).encode() if normalize else raw


def head(df: DataFrame, n: int) -> DataFrame:
    if n < 1:
        raise EngineError("usage", "-head takes a number from 1 up", "-head 至少為 1")
    return df.where(F.col("record") <= n)


def count(df: DataFrame) -> int:
    return df.count()


def check_tail(n: int, most: int = 1_000_000) -> None:
    if not 1 <= n <= most:
        raise EngineError("usage", f"-tail takes a number from 1 to {most}", f"-tail 介於 1 與 {most}")


def tail(df: DataFrame, n: int, total: int | None = None, most: int = 1_000_000) -> DataFrame:
    check_tail(n, most)
    return df.where(F.col("record") > (count(df) if total is None else total) - n)


def checked_range(first: int | None, last: int | None, total: int) -> tuple[int, int]:
    """Inclusive; either end may be open. A start past the end is an error, an end past it is not."""
    low = 1 if first is None else first
    if low < 1 or (last is not None and last < low):
        raise EngineError("usage", "the range is empty", "範圍是空的")
    if low > total:
        raise EngineError("out-of-range", f"record {low} is past the end", f"第 {low} 筆超出檔尾")
    return low, total if last is None else min(last, total)


def mid(df: DataFrame, first: int | None, last: int | None, total: int | None = None) -> DataFrame:
    low, high = checked_range(first, last, count(df) if total is None else total)
    return df.where(F.col("record").between(low, high))


def get_cell(table: Table, record: int, column: str | int) -> bytes:
    at = table.header.resolve(column)
    found = table.narrowed(record, record).df.select(F.col("fields")[at]).take(1) if record >= 1 else []
    if not found:
        raise EngineError("out-of-range", f"there is no record {record}", f"沒有第 {record} 筆")
    return bytes(found[0][0])


def matches(table: Table, needle: str | bytes, scope: Scope = Scope(), normalize: bool = False, include_headers: bool = False) -> DataFrame:
    """record, line, field, value of each cell that holds the needle. Header hits have record 0."""
    want = _needle(needle, normalize)
    if scope.record is not None:
        if scope.record < 1 or scope.record > table.total():
            raise EngineError("out-of-range", f"there is no record {scope.record}", f"沒有第 {scope.record} 筆")
        table = table.narrowed(scope.record, scope.record)
    df = table.df if normalize else table.holding(want)
    # Records without a hit are dropped before they are taken apart.
    at = None if scope.column is None else table.header.resolve(scope.column)
    holds = lambda v: F.contains(nfc(v) if normalize else v, F.lit(want))
    if at is not None:
        out = df.select("record", "line", F.lit(at + 1).alias("field"), F.col("fields")[at].alias("value"))
    else:
        if not normalize:
            df = df.where(F.exists("fields", holds))
        out = df.select("record", "line", F.posexplode("fields").alias("field", "value")).withColumn("field", F.col("field") + 1)
    out = out.where(holds(F.col("value")))
    if include_headers and scope.record is None and table.header.rows:
        rows = [(0, i + 1, k + 1, v, str(i)) for i, row in enumerate(table.header.rows) for k, v in enumerate(row) if at in (None, k)]
        heads = df.sparkSession.createDataFrame(rows, "record long, line long, field int, value binary, header_row string").where(holds(F.col("value")))
        out = heads.unionByName(out.withColumn("header_row", F.lit(None).cast("string")))
    return out


def a1(field: Column, row: Column) -> Column:
    """Spreadsheet address; columns go to ZZZ."""
    n = field - 1
    letter = lambda v: F.char(F.lit(65) + v)
    one, two = letter(n % 26), letter(F.floor((n - 26) / 26) % 26)
    three = letter(F.floor((n - 702) / 676) % 26)
    return F.concat(F.when(n >= 702, three).otherwise(""), F.when(n >= 26, two).otherwise(""), one, row.cast("string"))


def report(table: Table, hits: DataFrame, language: str = "en", physical: bool = False, a1_notation: bool = False) -> DataFrame:
    """Locating report: record, field, text (address, TAB, column, TAB, value), in file order when sorted by them."""
    names = F.array(*map(F.lit, table.header.names(language)))
    two = len(table.header.rows) > 1
    if "header_row" in hits.columns:
        label = F.when(F.col("record") > 0, F.col("record").cast("string")).otherwise(F.when(F.lit(two), F.concat(F.lit("0"), F.when(F.col("header_row") == "0", "a").otherwise("b"))).otherwise("0"))
        sheet_row = F.when(F.col("record") > 0, F.col("record") + len(table.header.rows)).otherwise(F.col("header_row").cast("int") + 1)
    else:
        label, sheet_row = F.col("record").cast("string"), F.col("record") + len(table.header.rows)
    address = F.concat(label, F.lit(":"), F.col("field").cast("string"))
    if physical:
        address = F.concat(address, F.lit("@L"), F.col("line").cast("string"))
    if a1_notation:
        address = F.concat(address, F.lit(" ["), a1(F.col("field"), sheet_row), F.lit("]"))
    escape = F.pandas_udf(lambda s: s.map(report_escape), T.StringType())
    plain = F.col("value").cast("string")
    # Most cells need no escape: those stay on the JVM.
    clean = F.is_valid_utf8(plain) & (F.length(plain) <= 200) & ~plain.rlike(r"[\x00-\x1f\x7f\\]")
    value = F.when(clean, plain).otherwise(escape("value"))
    return hits.select("record", "field", F.concat_ws("\t", address, names[F.col("field") - 1], value).alias("text"))


def filtered(table: Table, needle: str | bytes, scope: Scope = Scope(), normalize: bool = False) -> DataFrame:
    """Whole records with a match."""
    want = _needle(needle, normalize)
    holds = lambda v: F.contains(nfc(v) if normalize else v, F.lit(want))
    if scope.record is not None:
        table = table.narrowed(scope.record, scope.record)
    df = table.df if normalize else table.holding(want)
    if scope.column is not None:
        return df.where(holds(table.column(scope.column)))
    if normalize:
        return df.join(matches(table, needle, scope, True).select("record").distinct(), "record", "left_semi")
    return df.where(F.exists("fields", holds))


def context(df: DataFrame, hits: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Records near a hit, with `match` and `gap` (true where a `--` line goes before it). The hits are spread
    to their neighbours, whose numbers alone say where gaps are, and df is joined to them once."""
    low, high = F.greatest(F.col("record") - before, F.lit(1)), F.col("record") + after
    spread = hits.select(F.col("record").alias("hit"), F.explode(F.sequence(low, high)).alias("record"))
    marked = spread.groupBy("record").agg(F.max(F.col("hit") == F.col("record")).alias("match"))
    earlier = marked.select((F.col("record") + 1).alias("record"), F.lit(True).alias("_joined"))
    first = hits.agg(F.min(low).alias("_first"))
    marked = marked.join(earlier, "record", "left").crossJoin(F.broadcast(first))  # one row
    gap = F.col("_joined").isNull() & (F.col("record") != F.col("_first"))
    return df.join(marked.select("record", "match", gap.alias("gap")), "record")


def meta_json(table: Table, ascii_only: bool = False) -> str:
    h = table.header
    names = [",".join(json_string(v, ascii_only, "a column name") for v in row) for row in h.rows]
    out = f'{{"meta":{{"format":"{table.format.value}","headers":{len(h.rows)},"fields":{len(h.rows[0]) if h.rows else 0}'
    out += f',"header":[{names[0]}]' if names else ""
    out += f',"header_zh":[{names[1]}]' if len(names) > 1 else ""
    kept = ",".join(f'{json_string(m.base.encode(), ascii_only)}:"{m.kind}"' for m in h.markers() if m.kind)
    return out + (f',"protected":{{{kept}}}' if kept else "") + "}}"


def closing_json(records: int, matched: int) -> str:
    return f'{{"meta":{{"records":{records},"matched":{matched}}}}}'


def record_json(table: Table, df: DataFrame, ascii_only: bool = False) -> DataFrame:
    """record, text: one JSON line for each record, fields in file order."""
    names = table.header.names()
    if table.header.rows and len(set(names)) < len(names):
        raise EngineError("ambiguous", "--json keys each record by column name, and a name is there twice", "--json 以欄名作為鍵，而有欄名重複")
    parts = [F.lit('{"record":'), F.col("record").cast("string"), F.lit(',"line":'), F.col("line").cast("string")]
    if "match" in df.columns:
        parts += [F.lit(',"match":'), F.col("match").cast("string")]
    parts.append(F.lit(',"fields":{'))
    for i, n in enumerate(names):
        cell = json_text(F.col("fields")[i], ascii_only, F.col("record"), F.lit(i + 1))
        parts += [F.lit(("," if i else "") + json_string(n.encode(), ascii_only) + ":"), cell]
    return df.select("record", F.concat(*parts, F.lit("}}")).alias("text"))


def hit_json(table: Table, hits: DataFrame, ascii_only: bool = False) -> DataFrame:
    """record, field, text: one JSON line for each cell that matches."""
    parts = [F.lit('{"record":'), F.col("record").cast("string"), F.lit(',"field":'), F.col("field").cast("string")]
    if "header_row" in hits.columns:
        label = F.when(F.col("header_row") == "1", "0b").otherwise("0a" if len(table.header.rows) > 1 else "0")
        parts.append(F.when(F.col("header_row").isNotNull(), F.concat(F.lit(',"header_row":"'), label, F.lit('"'))).otherwise(""))
    for key, row in zip(("header_en", "header_zh"), table.header.rows, strict=False):
        names = F.array(*(F.lit(json_string(v, ascii_only, "a column name")) for v in row))
        parts += [F.lit(f',"{key}":'), names[F.col("field") - 1]]
    value = json_text(F.col("value"), ascii_only, F.col("record"), F.col("field"))
    return hits.select("record", "field", F.concat(*parts, F.lit(',"value":'), value, F.lit(',"line":'), F.col("line").cast("string"), F.lit("}")).alias("text"))


def json_text(value: Column, ascii_only: bool, record: Column, field: Column) -> Column:
    """A cell as a JSON string, by built-in functions; bytes that are not UTF-8 are refused. Only
    --json-ascii, which needs the code units of a character, goes through Python."""
    text = value.cast("string")
    where = F.concat(F.lit("record "), record.cast("string"), F.lit(", field "), field.cast("string"))
    fault = [F.lit(TRAVEL + '["malformed", "'), where, F.lit(' is not valid UTF-8, so it has no JSON form", "'), where, F.lit('不是合法的 UTF-8"]' + TRAVEL)]
    checked = F.when(~F.is_valid_utf8(text), F.raise_error(F.concat(*fault)).cast("string"))
    if ascii_only:
        ascii_json = F.pandas_udf(lambda s: s.map(lambda v: json_string(v.encode(), True)), T.StringType())
        return checked.otherwise(ascii_json(F.when(F.is_valid_utf8(text), text).otherwise("")))
    quoted = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    every = quoted
    for c in range(0x20):
        every = F.replace(every, F.lit(chr(c)), F.lit(JSON_NAMED.get(c) or f"\\u{c:04x}"))
    return checked.otherwise(F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1f]"), every).otherwise(quoted), F.lit('"')))


def reasons(table: Table, needle: str | bytes, scope: Scope = Scope(), normalize: bool = False) -> DataFrame:
    """For tracing: record, emitted and why, for every record."""
    want = _needle(needle, normalize)
    holds = lambda v: F.contains(nfc(v) if normalize else v, F.lit(want))
    hit = F.lit(False)
    for i in range(table.header.width) if scope.column is None else [table.header.resolve(scope.column)]:
        hit = hit | holds(F.col("fields")[i])
    inside = F.lit(True) if scope.record is None else F.col("record") == scope.record
    why = F.when(~inside, "outside the search scope").when(hit, "a cell holds the needle").otherwise("no cell holds the needle")
    return table.df.select("record", (inside & hit).alias("emitted"), why.alias("reason"))


def page(df: DataFrame, first: int, last: int, total: int) -> DataFrame:
    """A window clamped to the table."""
    return df.where(F.col("record").between(max(1, first), min(last, total)))


def wrapped_page(df: DataFrame, first: int, size: int, total: int) -> DataFrame:
    """`size` records from `first` on, going on at record 1; `place` orders them."""
    size = min(size, total)
    place = F.pmod(F.col("record") - F.lit(first), F.lit(max(total, 1)))
    return df.withColumn("place", place).where(F.col("place") < size)


def first_hit(hits: DataFrame) -> tuple[int, int] | None:
    found = hits.orderBy("record", "field").select("record", "field").take(1)
    return tuple(found[0]) if found else None


def protected_columns(table: Table) -> dict[str, Marker]:
    return {m.base: m for m in table.header.markers() if m.kind}

