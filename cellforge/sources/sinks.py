"""Output: ordered text over executors, and single files that appear whole or not at all."""

from __future__ import annotations

import itertools
import logging
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import EngineError, Format, Header
from .parser import encode, parse, parse_stretch
from .table import Table

log = logging.getLogger("cellforge")


@contextmanager
def refusals() -> Iterator[None]:
    """A refusal that a task raised comes out as itself, with its code and both messages."""
    try:
        yield
    except EngineError:
        raise
    except Exception as e:
        if (refusal := EngineError.arrived(e)) is None:
            raise
        raise refusal from e


def _quoted(v: Column) -> Column:
    text = v.cast("string")
    special = F.contains(v, F.lit(b",")) | F.contains(v, F.lit(b'"')) | F.contains(v, F.lit(b"\n")) | F.contains(v, F.lit(b"\r"))
    first, last = F.substring(v, 1, 1), F.substring(v, -1, 1)
    edge = first.isin(F.lit(b" "), F.lit(b"\t")) | last.isin(F.lit(b" "), F.lit(b"\t"))
    return F.when(special | edge, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def escape_two(v: Column) -> Column:
    text = v.cast("string")
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def encoded_cell(v: Column, format: Format) -> Column:
    """One cell as the format writes it; built-in functions only, bytes pass unchanged."""
    if format is Format.LINES:
        return v.cast("string")
    return _quoted(escape_two(v).cast("binary") if format is Format.TWO else v)


def encoded_record(table: Table, fields: str = "fields", raws: str = "raws", rownum: bool = False) -> Column:
    """One record without its line feed: an untouched cell keeps its bytes, the others are written anew."""
    made = F.concat_ws(",", F.transform(fields, lambda v: encoded_cell(v, table.format)))
    kept = F.concat_ws(",", F.transform(fields, lambda v, i: F.coalesce(F.col(raws)[i].cast("string"), encoded_cell(v, table.format))))
    line = F.when(F.col(raws).isNull(), made).otherwise(kept)
    return F.concat(F.col("record").cast("string"), F.lit(","), line) if rownum else line


def header_lines(table: Table, rownum: bool = False) -> list[bytes]:
    extra = [b"rownum", "列號".encode()]
    return [encode([*([extra[i]] if rownum else []), *row], table.format) for i, row in enumerate(table.header.rows)]


def in_order(df: DataFrame) -> DataFrame:
    keys = ["order", "phase", "seq"] if "order" in df.columns else [k for k in ("record", "field") if k in df.columns]
    return df.orderBy(*keys)


def text_lines(df: DataFrame, ordered: bool = False) -> Iterator[bytes]:
    """The column `text` in file order, one partition at a time on the driver. ordered: it is in that order already."""
    for row in (df if ordered else in_order(df)).select(F.col("text").cast("binary")).toLocalIterator(prefetchPartitions=True):
        yield bytes(row[0]) + b"\n"


def write_parts(df: DataFrame, path: str, ordered: bool = False) -> None:
    """The column `text` in file order, as numbered part files: the form for tables that one machine does not hold."""
    (df if ordered else in_order(df)).select("text").write.text(path)


@contextmanager
def parts_beside(df: DataFrame, path: str, ordered: bool) -> Iterator[list[Path]]:
    """Part files of the column `text`, written by the executors beside a destination that they share with the driver."""
    target = Path(path).absolute()
    folder = target.parent / f".{target.name}.{uuid.uuid4().hex}"
    try:
        write_parts(df, folder.as_uri(), ordered)
        yield sorted(folder.glob("part-*"))
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def joined(parts: list[Path], final_feed: bool = True) -> Iterator[bytes]:
    """The bytes of part files one after the other; without the last line feed, unless the last line is empty."""
    held = b""
    for part in parts:
        with open(part, "rb") as f:
            while piece := f.read(1 << 22):
                piece = held + piece
                held = piece[-2:]
                yield piece[:-2]
    empty = held in (b"\n", b"\n\n")
    yield held if final_feed or empty else held.removesuffix(b"\n")


def check_target(path: str) -> Path:
    target = Path(path)
    if not path or not target.parent.is_dir() or target.is_dir():
        raise EngineError("usage", f"cannot write to {path!r}", f"無法寫入 {path!r}")
    return target


def write_whole(path: str, pieces: Iterable[bytes], replace: bool = True) -> None:
    """Writes beside the destination, syncs, then takes its place; a failure leaves nothing behind."""
    target = check_target(path)
    fd, temp = tempfile.mkstemp(prefix=f".{target.name}.", dir=target.parent)
    try:
        with os.fdopen(fd, "wb") as f:
            for piece in pieces:
                f.write(piece)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(temp, target.stat().st_mode & 0o7777 if target.exists() else 0o644)
        if replace:
            os.replace(temp, target)
        else:
            try:
                os.link(temp, target)
            except FileExistsError:
                raise EngineError("exists", f"{path} exists already", f"{path} 已存在") from None
    finally:
        if os.path.exists(temp):
            os.unlink(temp)
    log.info("wrote %s", path)


def promise(path: str, table: Table, headers_kept: bool, shape: str = "csv") -> None:
    """What a destination's suffix promises must hold."""
    if path.lower().endswith(".md"):
        if shape != "md":
            raise EngineError("usage", "a .md file is written with -md", ".md 檔要用 -md 寫出")
        return
    to = Format.of(path)
    if to is Format.LINES:
        return
    if shape != "csv" or not headers_kept:
        raise EngineError("usage", f"a {to.value} file holds header rows and records, so -t and no other shape", f"{to.value} 檔需要 -t，且不能是其他形狀")
    if to is not table.format or to.header_rows != len(table.header.rows):
        raise EngineError("usage", "header rows differ between the input and the output; formats are not converted", "輸入與輸出的標頭列數不同，不轉換格式")


def record_lines(table: Table, rownum: bool = False) -> DataFrame:
    """The column `text`, one row for each line of the file that a table becomes, but for its header."""
    lines = getattr(table, "lines", None)
    return lines(rownum) if lines else table.df.withColumn("text", encoded_record(table, rownum=rownum))


def write_table(table: Table, path: str, headers: bool = True, rownum: bool = False, final_newline: bool | None = None) -> None:
    """A table as one file. Executors write a part for each partition, the driver puts them in a row.
    final_newline: None keeps the state of the file that the table is an edit of."""
    promise(path, table, headers)
    check_target(path)
    feed = not table.open_end if final_newline is None else final_newline
    with refusals(), parts_beside(record_lines(table, rownum), path, table.ordered) as parts:
        head = header_lines(table, rownum) if headers else []
        some = any(part.stat().st_size for part in parts)
        write_whole(path, itertools.chain(head, joined(parts, feed) if some else []))


def edit_in_place(path: str, made: Callable[[], Table], backup: bool = False) -> None:
    """Runs an edit of a file and puts the result in its place; the backup must not exist yet."""
    saved = path + ".bak"
    if backup:
        if os.path.exists(saved):
            raise EngineError("exists", f"{saved} exists already", f"{saved} 已存在")
        shutil.copy2(path, saved)
    try:
        write_table(made(), path)
    except BaseException:
        if backup:
            os.unlink(saved)
        raise


def append_rows(path: str, rows: list[bytes], headers: int | None = None, header: Header | None = None) -> bytes:
    """Appends to a file with one write, in the file's own line ending. Returns what was written.
    header: of a file that has been validated already; without it, the whole file is read here first."""
    from .table import header_rows_for, last_byte

    format, count = header_rows_for(path, headers)
    before = os.path.getsize(path)
    if header is None:
        with open(path, "rb") as f:
            header = parse(f.read(), format, count)[0]
    with open(path, "rb") as f:
        start = f.read(65536)
    crlf = b"\r\n" in start and format is not Format.TWO
    out = b"" if not before or last_byte(path, before) == b"\n" else (b"\r\n" if crlf else b"\n")
    for text in rows:
        found = list(parse_stretch(text if text.endswith(b"\n") else text + b"\n", format))
        if len(found) != 1:
            raise EngineError("usage", "a row must be one record", "一列必須剛好是一筆")
        if header.width and format is not Format.LINES and len(found[0].fields) != header.width:
            raise EngineError("ragged", f"the row has {len(found[0].fields)} fields where {header.width} are expected", "這一列的欄數不對")
        for i, m in enumerate(header.markers() if header.rows else []):
            if m.kind:
                raise EngineError("protected", f'-append would put a raw value into the protected column "{m.base}" ({i + 1})', "附加會把未保護的值放進受保護的欄位")
        line = encode(found[0].fields, format)
        out += line[:-1] + b"\r\n" if crlf else line
    with open(path, "ab") as f:
        if os.fstat(f.fileno()).st_size != before:
            raise EngineError("conflict", "the file grew while it was being checked", "檔案在檢查期間變大了")
        f.write(out)
        f.flush()
        os.fsync(f.fileno())
    log.info("appended %d row(s) to %s", len(rows), path)
    return out


def create(path: str, titles: bytes, titles_zh: bytes | None = None) -> None:
    """A new file of header rows only; never replaces one."""
    format = Format.of(path)
    rows = [next(parse_stretch(t + b"\n", Format.CSV)).fields for t in (titles, titles_zh) if t is not None]
    if len(rows) != format.header_rows:
        raise EngineError("usage", f"a {format.value} file has {format.header_rows} header row(s)", f"{format.value} 檔有 {format.header_rows} 列標頭")
    for row in rows:
        if len(set(row)) < len(row) or any(not t or b":" in t for t in row):
            raise EngineError("usage", "titles must be unique, not empty and without a colon", "欄名必須不重複、不空白、不含冒號")
    header = Header(tuple(map(tuple, rows)), len(rows[0]))
    header.check(format)
    write_whole(path, [encode(list(r), format) for r in header.rows], replace=False)


def parse_bytes(data: bytes | Iterable[bytes], format: Format, headers: int | None = None) -> tuple[Header, list]:
    """Library surface: a table from memory, standard input or a pipe."""
    return parse(data if isinstance(data, bytes) else b"".join(data), format, headers)


def audit_log(path: str, inputs: Iterable[str] = ()) -> logging.Handler:
    """An append-only log of requests on the driver; it must not be one of the files at work."""
    if any(os.path.exists(path) and os.path.exists(p) and os.path.samefile(path, p) for p in inputs):
        raise EngineError("usage", "the log is one of the files at work", "日誌檔與處理中的檔案相同")
    handler = logging.FileHandler(path, mode="a", encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s.%(msecs)03d %(levelname)s %(message)s", "%Y-%m-%dT%H:%M:%S"))
    log.addHandler(handler)
    log.setLevel(logging.INFO)
    return handler
