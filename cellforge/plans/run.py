"""One request from start to end: validated, planned as DataFrames, written."""

from __future__ import annotations

import logging
import os
import sys
from collections.abc import Iterator
from dataclasses import replace
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import markdown_cell
from ..model import EngineError, Format
from ..operators import edit as E
from ..operators import protect, select
from ..sources import index, markdown, sinks
from ..sources.table import NAMES, SPLIT_BYTES, Table, file_size
from .address import checked_cell
from .request import Request, validate

log = logging.getLogger("cellforge")
#: An append to a file of this size leaves an index behind, if there is none.
INDEX_FROM = 16 << 20


def _in_memory(spark: SparkSession, rows: list[tuple], header, format: Format, path: str = "", open_end: bool = False) -> Table:
    """Records (record, line, offset, fields, raws) that the driver holds, in one partition."""
    kinds = [pa.int64()] * 3 + [pa.list_(pa.binary())] * 2
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    data = pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)
    return Table(spark.createDataFrame(data).coalesce(1), header, format, path, ordered=True, open_end=open_end, known=len(rows))


def _opened(spark: SparkSession, r: Request, stdin: BinaryIO | None) -> tuple[Table, markdown.Layout | None]:
    if r.stdin:
        data = (stdin or sys.stdin.buffer).read()
        format = {0: Format.LINES, 1: Format.CSV, 2: Format.TWO}[r.headers]
        header, records = sinks.parse_bytes(data, format, r.headers)
        rows = [(x.number, x.line, x.offset, x.fields, x.raws(format)) for x in records]
        return _in_memory(spark, rows, header, format, "", bool(data) and not data.endswith(b"\n")), None
    if r.from_markdown:
        with open(r.input, "rb") as f:
            header, rows, format, place, lines = markdown.read_markdown(f.read(), r.md_table)
        data = [(i, place.header + 2 + i, 0, row, None) for i, row in enumerate(rows, 1)]
        return _in_memory(spark, data, header, format, r.input), markdown.Layout.of(lines, place)
    return index.open_indexed(spark, r.input, r.headers, not r.no_index, truncate_partial=r.truncate_partial), None


def _edits(r: Request, table: Table, stdin: BinaryIO | None) -> E.Edits:
    """The batch, once every claim of its addresses holds."""
    enc = lambda v: v if isinstance(v, bytes) else v.encode()
    value = None
    if r.value_file:
        if not os.path.isfile(r.value_file):
            raise EngineError("usage", f"--value-file {r.value_file}: no such regular file", f"--value-file {r.value_file}：沒有這個一般檔案")
        with open(r.value_file, "rb") as f:
            value = f.read()
    elif r.value_stdin:
        value = (stdin or sys.stdin.buffer).read()
    updates = [(*checked_cell(table, u[0], u[1]), value if value is not None else enc(u[2])) for u in r.update]
    blank = [checked_cell(table, *cell) for cell in r.delete_cell]
    return E.Edits([(n, enc(v)) for n, v in r.insert], [enc(v) for v in r.append], r.delete, updates, [(enc(a), enc(b)) for a, b in r.update_where], blank, r.drop_column, [(n, enc(t), enc(v)) for n, t, v in r.add_column])


def run(spark: SparkSession, request: Request, stdin: BinaryIO | None = None) -> Iterator[bytes]:
    """Output lines of a request; requests that write files yield nothing. A refusal keeps its code, wherever it arose."""
    r = validate(request)
    handler = sinks.audit_log(r.log, [p for p in (r.input, r.output, r.keyfile, r.value_file) if p]) if r.log else None
    log.info("request %r", r)
    try:
        try:
            with sinks.refusals():
                yield from _run(spark, r, stdin)
        except EngineError as e:
            raise _first_fault(spark, r, e) from e.__cause__
        log.info("done %s", r.output or r.input or "")
    except BaseException as e:
        log.error("failed: %s", e.code if isinstance(e, EngineError) else type(e).__name__)
        raise
    finally:
        if handler:
            sinks.log.removeHandler(handler)
            handler.close()


def _first_fault(spark: SparkSession, r: Request, fault: EngineError) -> EngineError:
    """Of several faults in a file the one that stands first, whichever task failed first."""
    if fault.__cause__ is None or not r.input or r.stdin or r.from_markdown:
        return fault
    table = index.open_indexed(spark, r.input, r.headers, not r.no_index, truncate_partial=r.truncate_partial)
    return table.first_fault() or fault if len(table.splits) > 1 else fault


def _run(spark: SparkSession, r: Request, stdin: BinaryIO | None) -> Iterator[bytes]:
    if r.create:
        sinks.create(r.output, *(t if isinstance(t, bytes) else t.encode() for t in r.create))
        return
    if r.count and not r.stdin:
        yield f"{index.record_count(spark, r.input, r.headers, not r.no_index)}\n".encode()
        return
    if r.build_index or r.verify_index:
        (index.build if r.build_index else index.verify)(spark, r.input, r.headers)
        return
    table, layout = _opened(spark, r, stdin)
    if r.count:
        yield f"{table.total()}\n".encode()
        return
    if r.transforms:
        secret = open(r.keyfile, "rb").read() if r.keyfile else None
        if r.hash:
            table = protect.hashed(table, r.hash, secret)
        elif r.encrypt:
            table = protect.encrypted(table, r.encrypt, secret)
        else:
            table = protect.decrypted(table, r.decrypt, secret)
        if not r.edits:  # written anew as a selection is, every line with its feed
            table = replace(table, open_end=False)
    if r.edits:
        edits = _edits(r, table, stdin)
        if r.dry_run:
            yield from (line.encode() + b"\n" for line in E.dry_run_lines(E.changes(table, edits)))
            return
        log.info("edit: %s", ", ".join(f"{len(v)} {k}" for k, v in vars(edits).items() if v))
        if r.from_markdown:
            done = E.edited(table, edits)
            with open(r.input, "rb") as f:
                data = f.read()
            rows = [[bytes(v) for v in row["fields"]] for row in sinks.in_order(done.df).select("fields").collect()]  # 16 MiB at most
            sinks.write_whole(r.output or r.input, [markdown.replace_table(data, r.md_table or 1, done.header, rows)])
            return
        if r.in_place and not r.transforms and not r.backup and vars(edits) == vars(E.Edits(append=edits.append)):
            _append(table, r, edits.append)
            return
        table = E.edited(table, edits)
    if r.in_place:
        made, indexed = table, index.split_bytes_of(r.input, r.headers)
        sinks.edit_in_place(r.input, lambda: made, r.backup)
        index.renew(spark, r.input, r.headers, indexed)
        return
    if (r.edits or r.transforms and not r.selects) and r.output and not r.to_markdown:
        sinks.write_table(table, r.output, headers=r.titles or r.edits)
        return
    if r.edits:
        yield from sinks.header_lines(table)
        yield from _without_last_feed(sinks.text_lines(sinks.record_lines(table), True), table.open_end)
        return
    lines = _shaped(table, r, layout)
    if r.output:
        sinks.promise(r.output, table, r.titles, "md" if r.markdown else "json" if r.json else "csv")
        sinks.write_whole(r.output, lines)
        return
    yield from lines


def _without_last_feed(lines: Iterator[bytes], open_end: bool) -> Iterator[bytes]:
    held = b""
    for line in lines:
        if held:
            yield held
        held = line
    yield held.removesuffix(b"\n") if open_end and len(held) > 1 else held


def _append(table: Table, r: Request, rows: list[bytes]) -> None:
    """Validates the file, unless its index has, adds the rows with one write, and keeps the index up."""
    indexed = index.split_bytes_of(r.input, r.headers)
    E.check_rows(table, rows)
    if indexed is None:
        table.df.select("record").write.format("noop").mode("overwrite").save()
    added = sinks.append_rows(r.input, rows, r.headers, table.header)
    if indexed is not None or os.path.getsize(r.input) >= INDEX_FROM:
        index.extend(r.input, r.headers, list(table.splits), indexed or SPLIT_BYTES, added, len(rows))


class _Counted:
    """Counts the records of a stream of (record, line) as it passes."""

    def __init__(self) -> None:
        self.records, self.last = 0, None

    def lines(self, df: DataFrame, ordered: bool, counts: str = "true") -> Iterator[bytes]:
        df = df if ordered else sinks.in_order(df)
        for record, counted, text in df.select("record", F.expr(counts), F.col("text").cast("binary")).toLocalIterator(prefetchPartitions=True):
            if counted and record > 0 and record != self.last:
                self.records, self.last = self.records + 1, record
            yield bytes(text) + b"\n"


def _shaped(table: Table, r: Request, layout: markdown.Layout | None = None) -> Iterator[bytes]:
    if r.get:
        record, column = checked_cell(table, *r.get)
        yield select.get_cell(table, record, column) + b"\n"
        return
    part, record = table, F.col("record")
    if r.head is not None:
        part = part.narrowed(1, r.head)
    if r.mid is not None:
        low, high = select.checked_range(*r.mid, table.total())
        if not r.context:
            part = part.narrowed(low, high)
    if r.tail is not None:
        select.check_tail(r.tail)
        part = part.narrowed(table.total() - r.tail + 1)
    df, ordered = part.df, part.ordered
    language = "zh" if r.chinese else "en"
    count = _Counted()
    if r.contains is not None:
        scope = select.Scope(r.search_record, r.search_column)
        if r.search_cell:
            scope = select.Scope(*checked_cell(table, *r.search_cell))
        if scope.record is not None and not 1 <= scope.record <= table.total():
            raise EngineError("out-of-range", f"there is no record {scope.record}", f"沒有第 {scope.record} 筆")
        if r.trace:
            why = select.reasons(part, r.contains, scope, r.normalize)
            text = F.concat(F.lit("record "), record.cast("string"), F.when(F.col("emitted"), " emitted: ").otherwise(" not emitted: "), F.col("reason"))
            yield from sinks.text_lines(why.select("record", text.alias("text")), part.ordered)
            return
        part = replace(part, known=table.total())
        hits = select.matches(part, r.contains, scope, r.normalize, r.include_headers)
        if r.context:
            own = hits.where("record > 0").select("record").distinct()
            own = own.where(record.between(low, high)) if r.mid else own
            df = select.context(table.narrowed(1, high).df if r.mid else part.df, own, r.before, r.after)
            ordered = False
        elif r.filter or r.markdown:
            if r.tail is None:
                df = select.filtered(part, r.contains, scope, r.normalize)
                ordered = ordered and not r.normalize
        elif r.json:
            yield select.meta_json(part, r.json_ascii).encode() + b"\n"
            yield from count.lines(select.hit_json(part, hits, r.json_ascii), ordered)
            yield select.closing_json(table.total(), count.records).encode() + b"\n"
            return
        else:
            yield from sinks.text_lines(select.report(part, hits, language, r.physical, r.a1), ordered)
            return
    part = replace(part, df=df, load=None, known=None)
    if r.json:
        yield select.meta_json(part, r.json_ascii).encode() + b"\n"
        text = select.record_json(part, df, r.json_ascii)
        counts = "false" if r.contains is None or r.tail is not None else "true"
        if r.context:
            text, counts = text.join(df.select("record", "match"), "record"), "match"
        yield from count.lines(text, ordered and not r.context, counts)
        yield select.closing_json(table.total(), count.records).encode() + b"\n"
    elif r.markdown:
        titles = markdown.header_cells(part.header, "zh" if r.chinese else "en" if r.english else None, r.rownum)
        rows = (df if ordered else sinks.in_order(df)).select("record", "fields").toLocalIterator(prefetchPartitions=True)
        cells = ([*([str(n)] if r.rownum else []), *(markdown_cell(bytes(v)) for v in fields)] for n, fields in rows)
        if r.pretty:
            lines = markdown.pretty(titles, list(cells))  # bounded by its own refusal
            yield from (x.encode() + b"\n" for x in lines)
            return
        kept = layout if r.md_style == "preserve" else None
        yield from (x.encode() + b"\n" for x in (kept.head(titles) if kept else markdown.compact_header(titles)))
        yield from ((kept.row(row) if kept else markdown.compact_row(row)).encode() + b"\n" for row in cells)
    else:
        if r.titles:
            yield from sinks.header_lines(part, r.rownum)
        text = sinks.encoded_record(part, rownum=r.rownum)
        if r.context:
            text = F.when(F.col("gap"), F.concat(F.lit("--\n"), text)).otherwise(text)
        yield from sinks.text_lines(df.withColumn("text", text), ordered)


def metrics(path: str) -> dict[str, int]:
    import resource

    return {"file_bytes": file_size(path), "peak_rss_bytes": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024, "pid": os.getpid()}
