"""The `strictcsv` data source, and tables opened through it.

Opening counts records in a job of its own: each split of the file is scanned from its first line
feed under both possible states, one row a split comes back, and the driver chains them. Reading
then knows each split's first record and line, so numbers are contiguous and the work is parallel,
quoted line feeds included. `Table.narrowed` drops splits before any task starts; a task gets its own
split and no other. The rows of a partition, and the partitions, come in the order of the file.

Ranges of records and needles go to the reader as options, not as Spark's pushed filters: all uses of one
DataFrame in a query share what was pushed last, so two ranges of one table would lose rows.

`fields` are the decoded cells, `raws` the cells as they stand in the file, null for a record that
encoding writes with the same bytes anyway. A search may hand its needle down (`Table.holding`):
splits without it are then read but not taken apart, and where an index vouches for the widths not
even their records are counted.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import EngineError, Format, Header
from .columnar import CHUNK, Shape, can_look_ahead, places_of, shape_of
from .parser import check_markdown, check_width, guard, parse_stretch, record_spans

SPLIT_BYTES = 32 << 20
MOST_HITS = 4096  # beyond so many in a split, its records are not picked out one by one
SCHEMA = "record long, line long, offset long, fields array<binary>, raws array<binary>"
LAST = 1 << 62  # beyond any record
NAMES = ["record", "line", "offset", "fields", "raws"]


def open_file(path: str):
    """A local path, or any URI that pyarrow can open."""
    if "://" in path or path.startswith("file:"):
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        return store.open_input_file(name)
    return open(path, "rb")


def file_size(path: str) -> int:
    if "://" in path or path.startswith("file:"):
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        return store.get_file_info(name).size
    return os.stat(path).st_size


def read_range(path: str, start: int, stop: int, at_feed: bool = True) -> bytes:
    """Bytes of the lines that start in [start, stop)."""
    with open_file(path) as f:
        if at_feed and start:
            f.seek(start - 1)
            while (piece := f.read(1 << 16)) and b"\n" not in piece:
                start += len(piece)
            if not piece:
                return b""
            start += piece.index(b"\n")
            if start >= stop:
                return b""
        f.seek(start)
        data = f.read(stop - start)
        while not data.endswith(b"\n") and (piece := f.read(1 << 16)):
            cut = piece.find(b"\n")
            data += piece if cut < 0 else piece[: cut + 1]
        return data


def line_start(path: str, at: int) -> int:
    """The first line start at or after a byte."""
    if at == 0:
        return 0
    with open_file(path) as f:
        f.seek(at - 1)
        pos = at - 1
        while piece := f.read(1 << 16):
            if (cut := piece.find(b"\n")) >= 0:
                return pos + cut + 1
            pos += len(piece)
        return pos


@dataclass(frozen=True)
class Split:
    start: int
    stop: int
    record: int  # number of the first record that starts here
    line: int
    records: int
    skip: int  # bytes that belong to a record of an earlier split
    tail: int = 0  # bytes beyond stop that finish the last record


class _Part(InputPartition):
    def __init__(self, split: Split | None) -> None:
        self.split = split


class StrictReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        plan = json.loads(options["plan"])
        self.splits = [Split(*s) for s in plan["splits"]]
        self.format, self.headers, self.width = Format(plan["format"]), plan["headers"], plan["width"]
        self.size, self.widths, self.truncate = plan["size"], plan["widths"], plan["truncate"]
        self.vouched, self.needle = plan["vouched"], bytes.fromhex(options.get("needle", ""))
        self.low, self.high = int(options.get("low", 1)), int(options.get("high", LAST))
        self.only_faults = "faults" in options

    def __getstate__(self) -> dict:
        """What travels to every task: not the splits, of which each task gets its own."""
        return {k: v for k, v in vars(self).items() if k != "splits"}

    def partitions(self):
        """One at least: without any, Spark would read a partition that is None."""
        return [_Part(s) for s in self.splits if s.records and s.record <= self.high and s.record + s.records > self.low] or [_Part(None)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        if part.split is None:
            return
        try:
            for batch in self._read(part.split):
                if not self.only_faults:
                    yield batch
        except EngineError as e:
            if not self.only_faults:
                raise e.for_travel() from None
            s, kinds = part.split, [pa.int64()] * 3 + [pa.list_(pa.binary())] * 2
            row = (s.record, s.line, s.start, [t.encode() for t in (e.code, e.message, e.message_zh)], None)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=NAMES)

    def _read(self, s: Split) -> Iterator[pa.RecordBatch]:
        with open_file(self.path) as f:
            f.seek(s.start + s.skip)
            data = f.read(s.stop - s.start - s.skip + s.tail)
        bom = guard(data) if s.start + s.skip == 0 else 0
        data = data[bom:] if bom else data
        if self.needle and self.vouched and self.needle not in data:
            return
        offset, last = s.start + s.skip + bom, s.stop + s.tail >= self.size
        shape = None
        if self.headers == 0 or s.record >= 1:
            shape = shape_of(data, self.format, last, self.width if self.widths else None)
        else:  # header rows may differ in width; they are the first records of the first split
            head = list(self._rows(data, s, offset, last, 1 - s.record))
            if len(head) == 1 - s.record and len(data) > (cut := self._after(data, 1 - s.record)):
                line = s.line + data.count(b"\n", 0, cut)
                data, offset, s = data[cut:], offset + cut, replace(s, record=1, line=line, records=s.records - len(head))
                shape = shape_of(data, self.format, last, self.width if self.widths else None)
            elif len(head) == 1 - s.record:
                return
        if shape is None:
            yield from self._by_record(data, s, offset, last)
        else:
            yield from self._by_column(data, shape, s, offset)

    def _after(self, data: bytes, records: int) -> int:
        """The byte after so many records."""
        ends = record_spans(data, self.format).ends
        return int(ends[records - 1]) + 1 if len(ends) >= records else len(data)

    def _rows(self, data: bytes, s: Split, offset: int, last: bool, most: int | None = None):
        for i, r in enumerate(parse_stretch(data, self.format, number=s.record, line=s.line, offset=offset, last=last, truncate=self.truncate)):
            if i == most:
                return
            yield r

    def _by_column(self, data: bytes, shape: Shape, s: Split, offset: int) -> Iterator[pa.RecordBatch]:
        low, high = max(0, self.low - s.record), min(len(shape), self.high - s.record + 1)
        picked = None
        if self.needle:
            places = [p for p, _ in zip(places_of(data, self.needle), range(MOST_HITS + 1), strict=False)]
            if len(places) <= MOST_HITS:
                picked = shape.records_at(np.array(places, np.int64))
                if not len(picked):
                    return
        lines = shape.lines() + s.line
        starts = shape.starts[shape.first[:-1]] + offset
        while low < high:
            end = max(low + 1, min(high, int(np.searchsorted(shape.ends, shape.ends[low] + CHUNK))))
            take = None if picked is None else picked[(picked >= low) & (picked < end)]
            if take is None or len(take):
                fields, raws = shape.arrays(low, end)
                numbers = np.arange(s.record + low, s.record + end)
                batch = pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(lines[low:end]), pa.array(starts[low:end]), fields, raws], names=NAMES)
                yield batch if take is None else batch.take(pa.array(take - low))
            low = end

    def _by_record(self, data: bytes, s: Split, offset: int, last: bool) -> Iterator[pa.RecordBatch]:
        block: list = []
        for r in self._rows(data, s, offset, last):
            if r.number >= 1 and self.widths:
                if self.format is not Format.LINES:
                    check_markdown(r.fields, r.number, r.line)
                check_width(r.fields, self.width, r.number, r.line)
            if max(1, self.low) <= r.number <= self.high:
                block.append(r)
            if r.number >= self.high or len(block) == 8192:
                yield self._batch(block)
                block = []
                if r.number >= self.high:
                    return
        if block:
            yield self._batch(block)

    def _batch(self, block: list) -> pa.RecordBatch:
        numbers = [pa.array([getattr(r, k) for r in block], pa.int64()) for k in ("number", "line", "offset")]
        cells = [pa.array(v, pa.list_(pa.binary())) for v in ([r.fields for r in block], [r.raws(self.format) for r in block])]
        return pa.RecordBatch.from_arrays([*numbers, *cells], names=NAMES)


class StrictSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strictcsv"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StrictReader:
        return StrictReader(dict(self.options))


def read_header(path: str, format: Format, headers: int) -> tuple[Header, int]:
    """The header rows, and the byte after them."""
    with open_file(path) as f:
        data, more = b"", f.read(1 << 16)
        while more:
            data += more
            skip = guard(data)
            spans = record_spans(data[skip:], format)
            if len(spans.ends) > max(headers, 1) or spans.fault >= 0:
                break
            more = f.read(1 << 16)
    skip = guard(data)
    rows = []
    for r in parse_stretch(data[skip:], format, number=1 - headers, offset=skip, last=not more):
        rows.append(r)
        if len(rows) > headers:
            break
    head = rows[:headers]
    if len(head) < headers:
        raise EngineError("malformed", f"the file ends before its {headers} header row(s)", "檔案在標頭列之前就結束了")
    width = len(rows[0].fields) if rows else 0
    header = Header(tuple(tuple(r.fields) for r in head), width)
    if headers:
        header.check(Format.TWO if headers == 2 else Format.CSV)
    return header, int(rows[headers].offset) if len(rows) > headers else len(data)


def plan_splits(spark: SparkSession, path: str, format: Format, headers: int, split_bytes: int = SPLIT_BYTES, truncate: bool = False, ranges: list[tuple[int, int]] | None = None) -> list[Split]:
    """Exact record and line numbers for every split, from one scan under both states."""
    if ranges is None:
        size = file_size(path)
        ranges = [(at, min(at + split_bytes, size)) for at in range(0, max(size, 1), split_bytes)]
    ranges = [(i, *r) for i, r in enumerate(ranges)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = read_range(path, a, b)
                plain, inner = record_spans(data, format), record_spans(data, format, format is Format.CSV)
                first = int(inner.ends[0]) + 1 if len(inner.ends) else len(data)
                quoted = format is Format.CSV
                rows.append((i, line_start(path, a), len(data), data.count(b"\n"), len(plain.ends), int(quoted and plain.inside), len(inner.ends), int(quoted and inner.inside), first, data.count(b"\n", 0, first), int(bool(data) and not data.endswith(b"\n"))))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows, strict=True)], names=names)

    names = ["i", "start", "n", "feeds", "r0", "e0", "r1", "e1", "first", "first_feeds", "cut"]
    if len(ranges) == 1:
        found = [r for b in scan(iter([pa.RecordBatch.from_pylist([dict(zip("iab", ranges[0], strict=True))])])) for r in b.to_pylist()]
    else:
        rows = spark.createDataFrame(ranges, "i long, a long, b long").repartition(len(ranges), "i").mapInArrow(scan, ", ".join(f"{n} long" for n in names)).collect()  # a row for each split
        found = sorted((r.asDict() for r in rows), key=lambda r: r["i"])
    out: list[Split] = []
    record, line, inside = 1 - headers, 1, False
    for r in (r for r in found if r["n"]):
        ended, open_ = (r["r1"], r["e1"]) if inside else (r["r0"], r["e0"])
        skip, skipped = (r["first"], r["first_feeds"]) if inside else (0, 0)
        if inside:  # bytes up to here finish the last record of an earlier split
            out[-1] = replace(out[-1], tail=out[-1].tail + skip)
        if not inside or ended:
            begins = ended - inside + (1 if open_ or (r["cut"] and not (truncate and format is Format.TWO)) else 0)
            out.append(Split(r["start"], r["start"] + r["n"], record, line + skipped, begins, skip))
            record += begins
            inside = bool(open_)
        line += r["feeds"]
    if inside and truncate and out:
        out[-1] = replace(out[-1], records=out[-1].records - 1)
    return out


@dataclass
class Table:
    """Records as a DataFrame (record, line, offset, fields, raws) with their header.

    ordered: partitions and their rows come in the order of the file. open_end: the file's last record
    has no line feed. load(needle, low, high): the same table
    from a reader that leaves out other records than low to high, and may leave out those without the needle."""

    df: DataFrame
    header: Header
    format: Format
    path: str = ""
    splits: tuple[Split, ...] = ()
    ordered: bool = False
    open_end: bool = False
    load: Callable[..., DataFrame] | None = None
    known: int | None = None  # number of records, where load is gone
    faults: Callable[[], DataFrame] | None = None  # a row for each split of the file with a fault

    def column(self, token: str | int) -> Column:
        return F.col("fields")[self.header.resolve(token)]

    def cells(self) -> DataFrame:
        """One row for each cell: record, line, field (from 1), value."""
        return self.df.select("record", "line", F.posexplode("fields").alias("field", "value")).withColumn("field", F.col("field") + 1)

    def total(self) -> int:
        """How many records there are: known for a file, else counted."""
        if self.load:
            return data_records(self.splits, len(self.header.rows))
        return self.df.count() if self.known is None else self.known

    def first_fault(self) -> EngineError | None:
        """The file's first fault, whichever task would meet one first."""
        found = self.faults().orderBy("offset").select("fields").first() if self.faults else None
        return EngineError(*(bytes(t).decode() for t in found["fields"])) if found else None

    def holding(self, needle: bytes) -> DataFrame:
        """df, possibly without records that do not hold the needle. It is no substitute for the search."""
        return self.load(needle) if self.load and can_look_ahead(needle) else self.df

    def narrowed(self, low: int = 1, high: int = LAST) -> Table:
        """Records low to high; only df and load are narrower."""
        load, inside = self.load, F.col("record").between(low, high)
        if load is None:
            return replace(self, df=self.df.where(inside), known=self.known)
        less = lambda needle=b"", a=1, b=LAST: load(needle, max(a, low), min(b, high))
        return replace(self, df=less(), load=less)


def data_records(splits: tuple[Split, ...] | list[Split], headers: int) -> int:
    return sum(s.records for s in splits) - headers if splits else 0


def header_rows_for(path: str, headers: int | None) -> tuple[Format, int]:
    """The format by suffix, and the header rows asked for: 0 turns them off, others must agree."""
    format = Format.of(path)
    if headers is None:
        return format, format.header_rows
    if headers not in (0, 1, 2):
        raise EngineError("usage", "--headers takes 0, 1 or 2", "--headers 只接受 0、1 或 2")
    if headers and format is not Format.LINES and headers != format.header_rows:
        raise EngineError("usage", f"--headers {headers} disagrees with the suffix of {path}", f"--headers {headers} 與副檔名不符")
    if format is Format.LINES and headers:
        format = Format.TWO if headers == 2 else Format.CSV
    return format, headers


def open_table(spark: SparkSession, path: str, headers: int | None = None, split_bytes: int = SPLIT_BYTES, truncate_partial: bool = False, check_widths: bool = True, splits: list[Split] | None = None, vouched: bool = False) -> Table:
    """Opens a delimited file. splits: from a trusted index (vouched: it has checked every width), else counted now."""
    format, count = header_rows_for(path, headers)
    header, _ = read_header(path, format, count)
    found = splits if splits is not None else plan_splits(spark, path, format, count, split_bytes, truncate_partial)
    size = file_size(path)
    plan = {"splits": [list(vars(s).values()) for s in found], "format": format.value, "headers": count, "width": header.width, "size": size, "widths": check_widths, "truncate": truncate_partial, "vouched": vouched}
    text = json.dumps(plan, separators=(",", ":"))
    spark.dataSource.register(StrictSource)

    def load(needle: bytes = b"", low: int = 1, high: int = LAST, **more: str) -> DataFrame:
        options = {"path": path, "plan": text, "needle": needle.hex(), "low": str(max(low, 1)), "high": str(high)} | more
        return spark.read.format("strictcsv").options(**options).load()

    open_end = bool(size) and last_byte(path, size) != b"\n"
    return Table(load(), header, format, path, tuple(found), True, open_end, load, faults=lambda: load(faults="only"))


def last_byte(path: str, size: int) -> bytes:
    with open_file(path) as f:
        f.seek(size - 1)
        return f.read(1)


def table_of(df: DataFrame, columns: list[str], header: Header | None = None, format: Format = Format.CSV) -> Table:
    """Any DataFrame with a `record` column as a table; cells are the text of its columns."""
    names = header or Header((tuple(c.encode() for c in columns),), len(columns))
    fields = F.array(*(F.coalesce(F.col(c).cast("string").cast("binary"), F.lit(b"")) for c in columns))
    none = F.lit(None).cast("array<binary>").alias("raws")
    return Table(df.select("record", F.col("record").alias("line"), F.col("record").alias("offset"), fields.alias("fields"), none), names, format)
