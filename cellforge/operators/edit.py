"""Batches of edits as one plan. All numbers refer to the input; the order within a record is insert
before, delete, update, blank, drop columns, add columns, whatever order the batch names them in."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import EngineError, Format, Header, Marker, as_text
from ..sources import sinks
from ..sources.parser import encode, parse_stretch
from ..sources.table import Table

FEW = 200  # edits that become one expression
BROADCAST_BYTES = 64 << 20  # of edits, which all come with the request


@dataclass
class Edits:
    insert: list[tuple[int, bytes]] = field(default_factory=list)
    append: list[bytes] = field(default_factory=list)
    delete: list[tuple[int | None, int | None]] = field(default_factory=list)
    update: list[tuple[int, str | int, bytes]] = field(default_factory=list)
    update_where: list[tuple[bytes, bytes]] = field(default_factory=list)
    blank: list[tuple[int, str | int]] = field(default_factory=list)
    drop: list[str | int] = field(default_factory=list)
    add: list[tuple[int, bytes, bytes]] = field(default_factory=list)  # place, titles as one CSV record, value


def one_record(text: bytes, format: Format, what: str) -> list[bytes]:
    rows = list(parse_stretch(text if text.endswith(b"\n") else text + b"\n", format))
    if len(rows) != 1:
        raise EngineError("usage", f"{what} must be one record", f"{what} 必須剛好是一筆")
    return rows[0].fields


def _guard(table: Table, columns: list[int], what: str) -> None:
    for c in columns:
        m = table.header.markers()[c] if table.header.rows else Marker("")
        if m.kind:
            raise EngineError("protected", f'{what} would put a raw value into the protected column "{m.base}"', f"{what} 會把未保護的值放進受保護的欄位「{m.base}」")


def check_rows(table: Table, rows: list[bytes]) -> None:
    """Rows to insert or append: one record each, of the table's width, with no raw value for a protected column."""
    _guard(table, list(range(table.header.width)), "-insert or -append")
    for text in rows:
        cells = one_record(text, table.format, "the row")
        if table.format is not Format.LINES and len(cells) != table.header.width:
            raise EngineError("ragged", f"the row has {len(cells)} fields where {table.header.width} are expected", f"這一列有 {len(cells)} 欄，應為 {table.header.width} 欄")


def located(table: Table, old: bytes) -> tuple[int, int]:
    """The one cell whose whole value is `old`; none or several are refused, with their addresses."""
    found = table.holding(old).where(F.array_contains("fields", F.lit(old))).select("record", F.posexplode("fields").alias("field", "value"))
    found = found.where(F.col("value") == F.lit(old)).orderBy("record", "field").limit(101).collect()
    where = ", ".join(f"{r['record']}:{r['field'] + 1}" for r in found[:100]) + (", ..." if len(found) > 100 else "")
    if not found:
        raise EngineError("no-match", f'no cell is exactly "{as_text(old)}"', f"沒有儲存格恰為「{as_text(old)}」")
    if len(found) > 1:
        raise EngineError("ambiguous", f'several cells are exactly "{as_text(old)}": {where}', f"不只一個儲存格恰為「{as_text(old)}」：{where}")
    return found[0]["record"], found[0]["field"]


def targets(table: Table, edits: Edits, total: int) -> dict[tuple[int, int], bytes]:
    """Cells to set, with all conflicts and bounds refused."""
    out: dict[tuple[int, int], bytes] = {}
    dropped = {table.header.resolve(c) for c in edits.drop}
    gone = [(a or 1, b or total) for a, b in edits.delete]
    for a, b in gone:
        if not 1 <= a <= b <= total:
            raise EngineError("out-of-range", f"-delete {a},{b} is out of range: there are {total} records", f"-delete {a},{b} 超出範圍：共 {total} 筆")
    named = [(r, table.header.resolve(c), v, "-update") for r, c, v in edits.update]
    named += [(r, table.header.resolve(c), b"", "-delete -cell") for r, c in edits.blank]
    named += [(*located(table, old), new, "-update-where") for old, new in edits.update_where]
    for r, c, v, what in named:
        if not 1 <= r <= total:
            raise EngineError("out-of-range", f"{what}: there is no record {r}", f"{what}：沒有第 {r} 筆")
        if (r, c) in out:
            raise EngineError("conflict", f"cell {r}:{c + 1} is edited twice", f"儲存格 {r}:{c + 1} 被編輯兩次")
        if any(a <= r <= b for a, b in gone):
            raise EngineError("conflict", f"record {r} is deleted and edited", f"第 {r} 筆同時被刪除與編輯")
        if c in dropped:
            raise EngineError("conflict", f"column {c + 1} is dropped and edited", f"第 {c + 1} 欄同時被刪除與編輯")
        if table.format is Format.LINES and b"\n" in v:
            raise EngineError("usage", "a line cannot hold a line feed", "一行不能含有換行")
        _guard(table, [c], what)
        out[r, c] = v
    for n, _ in edits.insert:
        if not 1 <= n <= total:
            raise EngineError("out-of-range", f"-insert {n} is out of range: there are {total} records", f"-insert {n} 超出範圍：共 {total} 筆")
    if edits.drop and (edits.insert or edits.append or edits.add):
        raise EngineError("usage", "-delete -col goes with neither -insert, -append nor -add-column", "-delete -col 不能與插入、附加或加欄並用")
    if len(dropped) >= table.header.width > 0 and dropped:
        raise EngineError("usage", "all columns would be dropped", "所有欄位都會被刪除")
    if table.format is Format.LINES and (edits.drop or edits.add):
        raise EngineError("usage", "lines have no columns", "純文字行沒有欄位")
    return out


def changes(table: Table, edits: Edits, total: int | None = None) -> DataFrame:
    """Dry run: record, field, column, old and new value of each cell that would change."""
    if edits.insert or edits.append or edits.delete or edits.drop or edits.add or edits.blank:
        raise EngineError("usage", "--dry-run goes with -update and -update-where only", "--dry-run 只與 -update、-update-where 並用")
    wanted = targets(table, edits, table.total() if total is None else total)
    names = table.header.names()
    rows = [(r, c + 1, names[c], v) for (r, c), v in sorted(wanted.items())]
    new = table.df.sparkSession.createDataFrame(rows, "record long, field int, column string, new binary")
    hit = table.df.where(F.col("record").isin(sorted({r for r, _ in wanted})))
    return hit.join(F.broadcast(new), "record").select("record", "field", "column", F.col("fields")[F.col("field") - 1].alias("old"), "new")  # a row for each edit


def dry_run_lines(found: DataFrame) -> list[str]:
    rows = found.orderBy("record", "field").collect()  # a row for each edit
    return [f'update {r["record"]}:{r["column"]}: "{as_text(bytes(r["old"]))}" -> "{as_text(bytes(r["new"]))}"' for r in rows]


def _titles(table: Table, edits: Edits) -> list[tuple[int, list[bytes], bytes]]:
    out = []
    for place, titles, value in edits.add:
        names = one_record(titles, Format.CSV, "the column title")
        if not 1 <= len(names) <= 2 or not 1 <= place <= table.header.width + 1:
            raise EngineError("usage", f"-add-column {place}: a place from 1 to {table.header.width + 1} and one or two titles", f"-add-column {place}：位置或欄名不對")
        if any(b":" in n for n in names):
            raise EngineError("usage", "a column title cannot hold a colon", "欄名不能含有冒號")
        out.append((place, names, value))
    return out


def _reshaped(row: list, drop: set[int], add: list[tuple[int, list[bytes], bytes]], pick) -> list:
    by_place = defaultdict(list)
    for place, names, value in add:
        by_place[place - 1].append(pick(names, value))
    out = []
    for i in range(len(row) + 1):
        out += by_place[i]
        if i < len(row) and i not in drop:
            out.append(row[i])
    return out


@dataclass
class Edited(Table):
    """An edited table. df has `order`, `phase` and `seq` for file order; numbers are those of the input.
    kept: its records in their old places, with `gone` on deleted ones that rows were inserted before."""

    kept: DataFrame | None = None
    before: list[tuple[int, list[bytes]]] = field(default_factory=list)
    after: list[list[bytes]] = field(default_factory=list)

    def lines(self, rownum: bool = False) -> DataFrame:
        """The file's lines; inserted rows stand before the record that they were inserted at, so nothing is sorted."""
        df = self.kept.withColumn("text", sinks.encoded_record(self, rownum=rownum))
        if self.before:
            by_record: dict[int, list[bytes]] = defaultdict(list)
            for n, cells in self.before:
                by_record[n].append(encode(cells, self.format)[:-1])
            rows = [(n, b"\n".join(lines)) for n, lines in by_record.items()]
            extra = df.sparkSession.createDataFrame(rows, "record long, _above binary")
            df = df.join(F.broadcast(extra), "record", "left")  # rows of the request
            text = F.when(F.col("gone"), F.col("_above").cast("string")).otherwise(F.concat_ws("\n", F.col("_above").cast("string"), "text"))
            df = df.withColumn("text", text)
        df = (df if self.ordered else df.orderBy("record")).select("text")
        if self.after:
            rows = [(encode(cells, self.format)[:-1],) for cells in self.after]
            last = df.sparkSession.createDataFrame(rows, "text binary").coalesce(1)
            df = df.union(last.select(F.col("text").cast("string").alias("text")))
        return df


def edited(table: Table, edits: Edits, total: int | None = None) -> Edited:
    """The edited table; all numbers are those of the input."""
    df, ordered = table.df, table.ordered
    total = table.total() if total is None else total
    width = table.header.width
    wanted = targets(table, edits, total)
    spark = df.sparkSession
    gone = F.lit(False)
    for a, b in edits.delete:
        gone = gone | F.col("record").between(a or 1, b or total)
    anchors = sorted({n for n, _ in edits.insert})
    df = df.withColumn("gone", gone)
    df = df.where(~F.col("gone") | F.col("record").isin(anchors)) if anchors else df.where(~F.col("gone"))
    by_column: dict[int, dict[int, bytes]] = defaultdict(dict)
    for (r, c), v in wanted.items():
        by_column[c][r] = v
    fields, raws, none = F.col("fields"), F.col("raws"), F.lit(None).cast("binary")
    if 0 < len(wanted) <= FEW:  # one expression
        cells = [fields[i] for i in range(width)]
        for c, rows in by_column.items():
            e: Column = none
            for r, v in rows.items():
                e = F.when(F.col("record") == r, F.lit(v)).otherwise(e)
            cells[c] = F.when(F.col("record").isin(list(rows)), e).otherwise(fields[c])
        touched = F.col("record").isin(sorted({r for r, _ in wanted}))
        left = F.array(*(F.when(~F.col("record").isin(list(by_column[i])), raws[i]) if i in by_column else raws[i] for i in range(width)))
        df = df.withColumns({"fields": F.when(touched, F.array(*cells)).otherwise(fields), "raws": F.when(touched & raws.isNotNull(), left).otherwise(raws)})
    elif wanted:  # a joined table of edits
        rows = [(r, c, v) for (r, c), v in wanted.items()]
        maps = spark.createDataFrame(rows, "record long, c int, v binary").groupBy("record").agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("_new"))
        small = sum(len(v) + 32 for v in wanted.values()) <= BROADCAST_BYTES
        df = df.join(F.broadcast(maps) if small else maps, "record", "left")
        ordered = ordered and small
        new = F.transform(fields, lambda v, i: F.coalesce(F.col("_new")[i], v))
        left = F.transform(raws, lambda v, i: F.when(F.col("_new")[i].isNull(), v))
        same = F.col("_new").isNull()
        df = df.withColumns({"fields": F.when(same, fields).otherwise(new), "raws": F.when(same, raws).otherwise(left)}).drop("_new")
    drop = {table.header.resolve(c) for c in edits.drop}
    add = _titles(table, edits)
    header = table.header
    if drop or add:
        cells = _reshaped([fields[i] for i in range(width)], drop, add, lambda _, v: F.lit(v))
        left = _reshaped([raws[i] for i in range(width)], drop, add, lambda *_: none)
        df = df.withColumns({"fields": F.array(*cells), "raws": F.when(raws.isNotNull(), F.array(*left))})
        rows = tuple(tuple(_reshaped(list(row), drop, add, lambda names, _, i=i: names[min(i, len(names) - 1)])) for i, row in enumerate(header.rows))
        header = Header(rows, len(cells))
    kept = df.select("record", "line", "offset", "fields", "raws", "gone")
    df = df.where(~F.col("gone")).select(F.col("record").alias("order"), F.lit(1).alias("phase"), F.lit(0).alias("seq"), "record", "line", "offset", "fields", "raws")
    before: list[tuple[int, list[bytes]]] = []
    after: list[list[bytes]] = []
    if edits.insert or edits.append:
        check_rows(table, [*(v for _, v in edits.insert), *edits.append])
        extra = [(n, 0, i, v) for i, (n, v) in enumerate(edits.insert)] + [(total + 1, 2, i, v) for i, v in enumerate(edits.append)]
        rows = []
        for order, phase, seq, text in extra:
            cells = _reshaped(one_record(text, table.format, "the row"), set(), add, lambda _, v: v)
            rows.append((order, phase, seq, cells))
            if phase:
                after.append(cells)
            else:
                before.append((order, cells))
        new = spark.createDataFrame(rows, "order long, phase int, seq int, fields array<binary>")
        absent = {k: F.lit(None).cast(t) for k, t in (("record", "long"), ("line", "long"), ("offset", "long"), ("raws", "array<binary>"))}
        df = df.unionByName(new.withColumns(absent))
    last_gone = any((a or 1) <= total <= (b or total) for a, b in edits.delete)
    open_end = table.open_end and not edits.append and not last_gone
    return Edited(df, header, table.format, table.path, ordered=ordered, open_end=open_end, kept=kept, before=before, after=after)
