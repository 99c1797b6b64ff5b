"""A positional index beside a file: the splits with their first record, line and byte, and a stamp of
the file. Any doubt about the stamp means the file is scanned again, silently; `verify` compares."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import replace

from pyspark.sql import SparkSession

from ..model import EngineError
from .sinks import refusals, write_whole
from .table import SPLIT_BYTES, Split, Table, data_records, header_rows_for, open_file, open_table, plan_splits

VERSION = 1


def index_path(path: str) -> str:
    return path + ".index"


def _stamp(path: str) -> dict[str, object]:
    s = os.stat(path)
    with open(path, "rb") as f:
        first = f.read(4096)
        f.seek(max(0, s.st_size - 4096))
        last = f.read()
    return {"size": s.st_size, "mtime_ns": s.st_mtime_ns, "first": hashlib.sha256(first).hexdigest()[:16], "last": hashlib.sha256(last).hexdigest()[:16]}


def build(spark: SparkSession, path: str, headers: int | None = None, split_bytes: int = SPLIT_BYTES) -> list[Split]:
    """Scans, validates every record's width, and writes the index."""
    format, count = header_rows_for(path, headers)
    with refusals():
        splits = plan_splits(spark, path, format, count, split_bytes)
        open_table(spark, path, headers, splits=splits).df.select("record").write.format("noop").mode("overwrite").save()
    _write(path, count, split_bytes, splits)
    return splits


def _write(path: str, headers: int, split_bytes: int, splits: list[Split]) -> None:
    body = {"version": VERSION, "headers": headers, "split_bytes": split_bytes, "stamp": _stamp(path), "splits": [list(vars(s).values()) for s in splits]}
    text = json.dumps(body)
    write_whole(index_path(path), [json.dumps({"sum": hashlib.sha256(text.encode()).hexdigest(), "body": text}).encode()])


def exists(path: str) -> bool:
    return os.path.exists(index_path(path))


def renew(spark: SparkSession, path: str, headers: int | None, split_bytes: int | None) -> None:
    """After a rewrite: the index of a file that had one (split_bytes of it, or None) is built again."""
    if split_bytes is not None:
        build(spark, path, headers, split_bytes)


def split_bytes_of(path: str, headers: int | None = None) -> int | None:
    body = _body(path, headers)
    return body["split_bytes"] if body else None


def extend(path: str, headers: int | None, old: list[Split], split_bytes: int, added: bytes, records: int) -> None:
    """After an append of whole, checked records to a file whose index was trusted: its last split grows,
    or a new one begins where that would be too long. Nothing is read again but the last split's lines."""
    format, count = header_rows_for(path, headers)
    splits, size = list(old), os.path.getsize(path)
    last = splits[-1] if splits else Split(0, 0, 1 - count, 1, 0, 0)
    closing = size - len(added) > 0 and added[:1] in (b"\n", b"\r") and last_open(path, size - len(added))
    if not splits or closing or last.stop + last.tail - last.start + len(added) <= split_bytes:
        grown = replace(last, stop=size, records=last.records + records, tail=0)
        splits = [*splits[:-1], grown]
    else:
        at = last.stop + last.tail
        feeds = 0
        with open_file(path) as f:
            f.seek(last.start + last.skip)
            feeds = f.read(at - last.start - last.skip).count(b"\n")
        splits.append(Split(at, size, last.record + last.records, last.line + feeds, records, 0))
    _write(path, count, split_bytes, splits)


def last_open(path: str, size: int) -> bool:
    """Whether the first `size` bytes of a file end without a line feed."""
    with open_file(path) as f:
        f.seek(size - 1)
        return f.read(1) != b"\n"


def _body(path: str, headers: int | None) -> dict | None:
    try:
        with open(index_path(path), encoding="utf-8") as f:
            outer = json.load(f)
        body = json.loads(outer["body"])
        fits = hashlib.sha256(outer["body"].encode()).hexdigest() == outer["sum"] and body["version"] == VERSION
        if fits and body["stamp"] == _stamp(path) and body["headers"] == header_rows_for(path, headers)[1]:
            return body
    except (OSError, ValueError, KeyError, TypeError):
        pass
    return None


def load(path: str, headers: int | None = None) -> list[Split] | None:
    """The splits, if the index is whole and the file is as it was."""
    body = _body(path, headers)
    return [Split(*s) for s in body["splits"]] if body else None


def verify(spark: SparkSession, path: str, headers: int | None = None) -> None:
    """Derives all splits again, from one scan cut where the index cuts, and compares them with the index."""
    body = _body(path, headers)
    if body is None:
        raise EngineError("index", "there is no index that fits the file", "沒有與檔案相符的索引")
    format, count = header_rows_for(path, headers)
    told = [Split(*s) for s in body["splits"]]
    starts = [0, *(s.start for s in told[1:])]
    ranges = list(zip(starts, [*starts[1:], os.path.getsize(path)], strict=True))
    fact = lambda s: (s.start + s.skip, s.stop + s.tail, s.record, s.line, s.records)
    if list(map(fact, plan_splits(spark, path, format, count, ranges=ranges))) != list(map(fact, told)):
        raise EngineError("index", "the index does not describe the file", "索引與檔案內容不符")


def open_indexed(spark: SparkSession, path: str, headers: int | None = None, use_index: bool = True, **options) -> Table:
    splits = load(path, headers) if use_index else None
    return open_table(spark, path, headers, splits=splits, vouched=splits is not None, **options)


def record_count(spark: SparkSession, path: str, headers: int | None = None, use_index: bool = True) -> int:
    """Data records, whatever their width; from the index at once, else from one scan."""
    splits = load(path, headers) if use_index else None
    if splits is None:
        format, count = header_rows_for(path, headers)
        splits = plan_splits(spark, path, format, count)
    return data_records(splits, header_rows_for(path, headers)[1])
