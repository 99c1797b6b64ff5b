"""The operators over the driver's Parquet tables, with the SQL they equal. Cells are string and integer columns."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .functions import crypto
from .functions.text import markdown_cell_column
from .model import TWO_HEADER, EngineError, Format, Header
from .operators import edit as E
from .operators import protect, select
from .plans.request import Request
from .plans.run import run
from .sources import index, markdown, sinks
from .sources.table import Table, open_table, table_of
from .streaming.search import arriving_lines, matching

Query = Callable[[SparkSession, str], DataFrame]
TASK_ROWS, MOST_TASKS = 200_000, 256


def numbered(df: DataFrame, key: str) -> DataFrame:
    """df with `record`, 1 up in the order of an integer key without repeats. The rows are cut at quantiles
    of the key, each part is numbered by itself and shifted by the counts before it."""
    n = df.count()
    parts = min(MOST_TASKS, max(1, -(-n // TASK_ROWS)))
    at = [i / parts for i in range(1, parts)]
    cuts = sorted(set(df.agg(F.percentile_approx(key, at, 10_000)).first()[0])) if at else []  # MOST_TASKS at most

    def part(low: int, high: int) -> Column:
        """The number of cuts at or below the key, by halving."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(key) < cuts[middle], part(low, middle)).otherwise(part(middle + 1, high))

    cut = df.withColumn("_part", part(0, len(cuts)))
    sizes = {r["_part"]: r["n"] for r in cut.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()} if cuts else {}
    before = [sum(sizes.get(j, 0) for j in range(i)) for i in range(len(cuts) + 1)]
    own = F.row_number().over(W.partitionBy("_part").orderBy(key)).cast("long")
    return cut.withColumn("record", own + F.array(*(F.lit(x).cast("long") for x in before))[F.col("_part")]).drop("_part")


def _df(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return numbered(spark.read.parquet(f"{sf_dir}/{name}.parquet"), key)


def _part(spark: SparkSession, sf_dir: str) -> Table:
    return table_of(_df(spark, sf_dir, "part", "p_partkey"), ["p_name", "p_brand", "p_type"])


_PART = "t AS (SELECT row_number() OVER (ORDER BY p_partkey) AS record, p_name, p_brand, p_type FROM part)"
_CELLS = "c AS (SELECT record, 1 AS field, 'p_name' AS name, p_name AS value FROM t UNION ALL SELECT record, 2, 'p_brand', p_brand FROM t UNION ALL SELECT record, 3, 'p_type', p_type FROM t)"
NEEDLE = "AN"


def _cols(table: Table) -> DataFrame:
    names = table.header.names()
    return table.df.select("record", *(F.col("fields")[i].cast("string").alias(n) for i, n in enumerate(names)))


def contains_report(spark: SparkSession, d: str) -> DataFrame:
    t = _part(spark, d)
    return select.report(t, select.matches(t, NEEDLE))


def contains_a1_report(spark: SparkSession, d: str) -> DataFrame:
    t = _part(spark, d)
    return select.report(t, select.matches(t, NEEDLE), physical=True, a1_notation=True)


def contains_filter(spark: SparkSession, d: str) -> DataFrame:
    t = _part(spark, d)
    return _cols(Table(select.filtered(t, NEEDLE), t.header, t.format))


def contains_column(spark: SparkSession, d: str) -> DataFrame:
    t = _part(spark, d)
    return _cols(Table(select.filtered(t, NEEDLE, select.Scope(column="p_type")), t.header, t.format))


def contains_row(spark: SparkSession, d: str) -> DataFrame:
    t = _part(spark, d)
    return select.matches(t, "a", select.Scope(record=7)).select("record", "field", F.col("value").cast("string").alias("value"))


def contains_cell(spark: SparkSession, d: str) -> DataFrame:
    t = _part(spark, d)
    return select.matches(t, "#", select.Scope(7, "p_brand")).select("record", "field", F.col("value").cast("string").alias("value"))


def normalize_contains(spark: SparkSession, d: str) -> DataFrame:
    docs = _df(spark, d, "documents", "doc_id")
    t = table_of(docs, ["text"])
    return select.matches(t, "e\u0301a", normalize=True).select("record", "field")


def include_headers(spark: SparkSession, d: str) -> DataFrame:
    t = _part(spark, d)
    return select.report(t, select.matches(t, "p_", include_headers=True))


def context_abc(spark: SparkSession, d: str) -> DataFrame:
    t = table_of(_df(spark, d, "orders", "o_orderkey"), ["o_orderstatus", "o_orderpriority"])
    hits = select.filtered(t, "URGENT").select("record")
    return select.context(t.df, hits, before=1, after=2).select("record", "match", "gap")


def head_records(spark: SparkSession, d: str) -> DataFrame:
    t = _part(spark, d)
    return _cols(Table(select.head(t.df, 25), t.header, t.format))


def tail_records(spark: SparkSession, d: str) -> DataFrame:
    t = _part(spark, d)
    return _cols(Table(select.tail(t.df, 25), t.header, t.format))


def mid_records(spark: SparkSession, d: str) -> DataFrame:
    t = _part(spark, d)
    return _cols(Table(select.mid(t.df, 11, 40), t.header, t.format))


def get_cell(spark: SparkSession, d: str) -> DataFrame:
    value = select.get_cell(_part(spark, d), 5, "p_brand")
    return spark.createDataFrame([(value.decode(),)], "value string")


def count_records(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("key", F.col("l_orderkey") * 16 + F.col("l_linenumber"))
    path = _written(table_of(numbered(lines, "key"), ["l_orderkey", "l_linenumber", "l_returnflag"]), "lines.csv")
    return _counted(spark, index.record_count(spark, path))


def rownum(spark: SparkSession, d: str) -> DataFrame:
    t = _part(spark, d)
    return t.df.select("record", sinks.encoded_record(t, rownum=True).alias("text"))


def csv_encode(spark: SparkSession, d: str) -> DataFrame:
    t = table_of(_df(spark, d, "documents", "doc_id"), ["text", "lang"])
    return t.df.select("record", sinks.encoded_record(t).alias("text"))


def two_header_encode(spark: SparkSession, d: str) -> DataFrame:
    t = table_of(_df(spark, d, "documents", "doc_id"), ["text"], Header(((b"text",), (b"text",)), 1), Format.TWO)
    return t.df.select("record", sinks.encoded_record(t).alias("text"))


def hash_sha256(spark: SparkSession, d: str) -> DataFrame:
    return _cols(_hashed(spark, d, None))


def _hashed(spark: SparkSession, d: str, secret: bytes | None) -> Table:
    t = table_of(_df(spark, d, "customer", "c_custkey"), ["c_name", "c_mktsegment"])
    return protect.hashed(t, "c_name", secret)


KEY = bytes(range(32))


def hmac_sha256(spark: SparkSession, d: str) -> DataFrame:
    return _cols(_hashed(spark, d, KEY)).drop("c_mktsegment")


def encrypt_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    t = table_of(_df(spark, d, "supplier", "s_suppkey"), ["s_name"])
    secret = b"a secret of more than sixteen bytes"
    return _cols(protect.decrypted(protect.encrypted(t, "s_name", secret), "all", secret))


def _edited(spark: SparkSession, d: str, edits: E.Edits) -> DataFrame:
    t = E.edited(_part(spark, d), edits)
    return t.df.select("order", "phase", "seq", *(F.col("fields")[i].cast("string").alias(n) for i, n in enumerate(t.header.names())))


EDITS = {
    "edit_insert": E.Edits(insert=[(3, b"x,y,z"), (3, b'"p,q",r,s')]),
    "edit_append": E.Edits(append=[b"x,y,z"]),
    "edit_delete": E.Edits(delete=[(2, 5), (10, None)]),
    "edit_blank": E.Edits(blank=[(4, "p_type")]),
    "edit_update": E.Edits(update=[(4, "p_type", b"new"), (6, 1, b"other")]),
    "edit_drop_column": E.Edits(drop=["p_brand"]),
    "edit_add_column": E.Edits(add=[(2, b"extra", b"v")]),
    "edit_batch": E.Edits(insert=[(3, b"x,y,z")], append=[b"l,m,n"], delete=[(5, 6)], update=[(9, "p_name", b"u")], blank=[(9, "p_brand")]),
}


def edit_update_where(spark: SparkSession, d: str) -> DataFrame:
    df = _df(spark, d, "nation", "n_nationkey")
    t = table_of(df, ["n_name"])
    old = df.where("record = 3").first()["n_name"].encode()
    return _cols(E.edited(t, E.Edits(update_where=[(old, b"changed")])))


def dry_run_changes(spark: SparkSession, d: str) -> DataFrame:
    out = E.changes(_part(spark, d), E.Edits(update=[(4, "p_type", b"new"), (6, 1, b"other")]))
    return out.select("record", "field", "column", F.col("old").cast("string").alias("old"), F.col("new").cast("string").alias("new"))


def json_records(spark: SparkSession, d: str) -> DataFrame:
    t = table_of(_df(spark, d, "nation", "n_nationkey"), ["n_nationkey", "n_name"])
    return select.record_json(t, t.df)


def json_cell_hits(spark: SparkSession, d: str) -> DataFrame:
    t = table_of(_df(spark, d, "nation", "n_nationkey"), ["n_nationkey", "n_name"])
    return select.hit_json(t, select.matches(t, "1"))


def markdown_cells(spark: SparkSession, d: str) -> DataFrame:
    return _df(spark, d, "documents", "doc_id").select("record", markdown_cell_column(F.coalesce("text", F.lit("")).cast("binary")).alias("cell"))


def max_display_width(spark: SparkSession, d: str) -> DataFrame:
    from .functions.text import display_width

    width = F.pandas_udf(lambda s: s.map(display_width), "int")
    return spark.read.parquet(f"{d}/nation.parquet").agg(F.max(width("n_name")).alias("width"))


def page_window(spark: SparkSession, d: str) -> DataFrame:
    df = _df(spark, d, "orders", "o_orderkey")
    return select.page(df, 90, 130, df.count()).select("record", "o_orderkey")


def page_wrap(spark: SparkSession, d: str) -> DataFrame:
    df = _df(spark, d, "nation", "n_nationkey")
    return select.wrapped_page(df, 20, 10, df.count()).select("place", "record", "n_name")


# Over files: a table is written as one, in the folder that executors share with the driver, and opened again.
_folders: list[str] = []


@atexit.register
def _clean() -> None:
    for folder in _folders:
        shutil.rmtree(folder, ignore_errors=True)


def _folder(spark: SparkSession) -> str:
    """A new folder under the one that spark.checkpoint.dir names, or a temporary one where it is unset (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.gettempdir()
    at = urlparse(root)
    if at.scheme not in ("", "file"):
        raise EngineError("usage", f"files are written to a mounted folder, and {root} is none", f"檔案要寫到掛載的資料夾，{root} 不是")
    path = f"{unquote(at.path)}/cellforge-files-{uuid.uuid4().hex}"
    os.makedirs(path)
    _folders.append(path)
    return path


def _written(table: Table, name: str) -> str:
    path = f"{_folder(table.df.sparkSession)}/{name}"
    sinks.write_table(table, path, final_newline=True)
    return path


def _reopened(spark: SparkSession, path: str, splits: int = 7, **options) -> Table:
    return open_table(spark, path, split_bytes=os.path.getsize(path) // splits + 1, **options)


def _counted(spark: SparkSession, n: int) -> DataFrame:
    return spark.createDataFrame([(n,)], "records long")


def _part_file(spark: SparkSession, d: str) -> str:
    return _written(_part(spark, d), "part.csv")


def _requested(spark: SparkSession, **asked) -> None:
    list(run(spark, Request(**asked)))


def _with_line(table: Table) -> DataFrame:
    return table.df.select("record", "line", *(F.col("fields")[i].cast("string").alias(n) for i, n in enumerate(table.header.names())))


def file_scan(spark: SparkSession, d: str) -> DataFrame:
    return _with_line(_reopened(spark, _part_file(spark, d)))


def file_scan_quoted(spark: SparkSession, d: str) -> DataFrame:
    path = _written(table_of(_df(spark, d, "documents", "doc_id"), ["text", "lang"]), "documents.csv")
    return _with_line(_reopened(spark, path, 23))


def file_two_header(spark: SparkSession, d: str) -> DataFrame:
    t = table_of(_df(spark, d, "documents", "doc_id"), ["text", "lang"], Header(((b"text", b"lang"), (b"t", b"l")), 2), Format.TWO)
    return _with_line(_reopened(spark, _written(t, f"documents.{TWO_HEADER}")))


def file_lines(spark: SparkSession, d: str) -> DataFrame:
    t = table_of(_df(spark, d, "part", "p_partkey"), ["p_name"], Header((), 1), Format.LINES)
    return _reopened(spark, _written(t, "part.txt")).df.select("record", "line", F.col("fields")[0].cast("string").alias("value"))


def file_window(spark: SparkSession, d: str) -> DataFrame:
    """Head, middle and tail of a file; no record is read twice."""
    t = _reopened(spark, _part_file(spark, d))
    middle = t.narrowed(*select.checked_range(11, 40, t.total())).df
    return t.narrowed(1, 5).df.union(middle).union(t.narrowed(t.total() - 4).df).select("record", "line", F.col("fields")[0].cast("string").alias("p_name"))


def file_get(spark: SparkSession, d: str) -> DataFrame:
    value = b"".join(run(spark, Request(input=_part_file(spark, d), get=(5, "p_brand@L6 [B6]"))))
    return spark.createDataFrame([(value.decode(),)], "value string")


def file_search(spark: SparkSession, d: str) -> DataFrame:
    path = _part_file(spark, d)
    index.build(spark, path, split_bytes=os.path.getsize(path) // 7 + 1)
    t = index.open_indexed(spark, path)
    return select.report(t, select.matches(t, NEEDLE), physical=True)


def file_search_nothing(spark: SparkSession, d: str) -> DataFrame:
    """A file of a header and nothing else."""
    path = f"{_folder(spark)}/empty.csv"
    _requested(spark, create=["p_name,p_brand"], output=path)
    t = open_table(spark, path)
    return select.report(t, select.matches(t, NEEDLE))


def file_append(spark: SparkSession, d: str) -> DataFrame:
    path = _part_file(spark, d)
    index.build(spark, path)
    _requested(spark, input=path, in_place=True, append=["x,y,z", 'l,"m,n",o'])
    index.verify(spark, path)
    return _cols(index.open_indexed(spark, path))


def file_edit(spark: SparkSession, d: str) -> DataFrame:
    path = _part_file(spark, d)
    _requested(spark, input=path, in_place=True, insert=[(3, "x,y,z")], append=["l,m,n"], delete=[(5, 6)], update=[(9, "p_name@L10", "u,v")], delete_cell=[(9, "p_brand")])
    return _with_line(_reopened(spark, path))


def _quoted_file(spark: SparkSession, d: str, final_newline: bool = True) -> str:
    """A file all of whose cells stand in quotes, though none needs them."""
    t = _part(spark, d)
    path = f"{_folder(spark)}/quoted.csv"
    sinks.write_whole(path, [b"p_name,p_brand,p_type\n"])
    text = F.concat(F.lit('"'), F.concat_ws('","', F.transform("fields", lambda v: v.cast("string"))), F.lit('"'))
    with sinks.parts_beside(t.df.select("record", text.alias("text")), path, False) as parts, open(path, "ab") as f:
        f.writelines(sinks.joined(parts, final_newline))
    return path


def file_edit_keeps_bytes(spark: SparkSession, d: str) -> DataFrame:
    path = _quoted_file(spark, d)
    out = path.replace("quoted.csv", "edited.csv")
    _requested(spark, input=path, output=out, titles=True, update=[(2, "p_brand", "new")], add_column=[(2, "extra", "v")])
    os.rename(out, out + ".txt")
    return open_table(spark, out + ".txt").df.where("record > 1").select((F.col("record") - 1).alias("record"), F.col("fields")[0].cast("string").alias("text"))


def file_final_newline(spark: SparkSession, d: str) -> DataFrame:
    """A file without a final line feed: edited, then without its last record."""
    rows = []
    for name, edit in (("update", {"update": [(1, "p_name", "x")]}), ("delete", {"delete": [(None, 3)]})):
        path = _quoted_file(spark, d, False)
        _requested(spark, input=path, in_place=True, **edit)
        with open(path, "rb") as f:
            rows.append((name, f.read()[-1:] == b"\n"))
    n = select.count(open_table(spark, path).df)
    _requested(spark, input=path, in_place=True, delete=[(n, n)])
    with open(path, "rb") as f:
        rows.append(("delete the last", f.read()[-1:] == b"\n"))
    return spark.createDataFrame(rows, "edit string, feed boolean")


def file_index_seek(spark: SparkSession, d: str) -> DataFrame:
    path = _part_file(spark, d)
    index.build(spark, path, split_bytes=1024)
    index.verify(spark, path)
    return _with_line(index.open_indexed(spark, path).narrowed(101, 120))


def file_encrypted(spark: SparkSession, d: str) -> DataFrame:
    secret = b"a secret of more than sixteen bytes"
    t = table_of(_df(spark, d, "supplier", "s_suppkey"), ["s_name", "s_nationkey"])
    path = _written(protect.encrypted(t, "s_name", secret), "supplier.csv")
    return _cols(protect.decrypted(_reopened(spark, path), "all", secret))


def file_markdown(spark: SparkSession, d: str) -> DataFrame:
    """A file as a Markdown document, edited there, and read again."""
    path = _written(table_of(_df(spark, d, "nation", "n_nationkey"), ["n_nationkey", "n_name"]), "nation.csv")
    out = path.replace(".csv", ".md")
    _requested(spark, input=path, output=out, markdown=True, titles=True)
    _requested(spark, input=out, in_place=True, markdown=True, titles=True, update=[(3, "n_name", "a|b")])
    with open(out, "rb") as f:
        header, rows, _, _, _ = markdown.read_markdown(f.read())
    return spark.createDataFrame([(i, *(v.decode() for v in row)) for i, row in enumerate(rows, 1)], f"record long, {header.names()[0]} string, {header.names()[1]} string")


def standard_input(spark: SparkSession, d: str) -> DataFrame:
    with open(_written(table_of(_df(spark, d, "nation", "n_nationkey"), ["n_nationkey", "n_name"]), "nation.csv"), "rb") as f:
        data = f.read()
    lines = b"".join(run(spark, Request(stdin=True, headers=1, contains="1", filter=True, rownum=True), io.BytesIO(data))).decode().splitlines()
    return spark.createDataFrame([(line,) for line in lines], "text string")


def streaming_search(spark: SparkSession, d: str) -> DataFrame:
    folder, name = _folder(spark), f"found_{uuid.uuid4().hex}"
    spark.read.parquet(f"{d}/part.parquet").select("p_name").write.text(f"file://{folder}/arriving")
    query = matching(arriving_lines(spark, f"file://{folder}/arriving"), "an").select("value").writeStream.format("parquet").option("path", f"file://{folder}/{name}").option("checkpointLocation", f"file://{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("value string").parquet(f"file://{folder}/{name}")


def search_reasons(spark: SparkSession, d: str) -> DataFrame:
    return select.reasons(_part(spark, d), NEEDLE, select.Scope(column="p_type"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        contains_report, contains_a1_report, contains_filter, contains_column, contains_row, contains_cell, normalize_contains, include_headers, context_abc,
        head_records, tail_records, mid_records, get_cell, count_records, rownum, csv_encode, two_header_encode, hash_sha256, hmac_sha256, encrypt_roundtrip,
        edit_update_where, dry_run_changes, json_records, json_cell_hits, markdown_cells, max_display_width, page_window, page_wrap,
        file_scan, file_scan_quoted, file_two_header, file_lines, file_window, file_get, file_search, file_search_nothing, file_append, file_edit, file_edit_keeps_bytes,
        file_final_newline, file_index_seek, file_encrypted, file_markdown, standard_input, streaming_search, search_reasons,
    )
} | {name: (lambda spark, d, e=e: _edited(spark, d, e)) for name, e in EDITS.items()}

_QUOTE = "CASE WHEN contains({0}, ',') OR contains({0}, '\"') OR contains({0}, chr(10)) OR contains({0}, chr(13)) OR left({0}, 1) IN (' ', chr(9)) OR right({0}, 1) IN (' ', chr(9)) THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"
_TWO = "replace(replace(replace(text, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r')"
_DOCS = "d AS (SELECT row_number() OVER (ORDER BY doc_id) AS record, coalesce(text, '') AS text, coalesce(lang, '') AS lang FROM documents)"
_EDIT = 'SELECT record AS "order", 1 AS phase, 0 AS seq, p_name, p_brand, p_type FROM t'
_HEX = lambda b: "from_hex('" + b.hex() + "')"
_IN, _OUT = (_HEX(bytes(x ^ k for x in crypto.hmac_key(KEY).ljust(64, b"\0"))) for k in (0x36, 0x5C))
_NATION = "t AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS record, n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation)"
_MARKDOWN = "replace(replace(replace(replace(replace(text, '\\', '\\\\'), '|', '\\|'), '<br>', '\\<br>'), chr(10), '<br>'), chr(9), '\\t')"
for _i in [*range(1, 9), *range(11, 32), 127]:
    _MARKDOWN = f"replace({_MARKDOWN}, chr({_i}), '\\x{_i:02X}')"

ORACLES: dict[str, str] = {
    "contains_report": f"WITH {_PART}, {_CELLS} SELECT record, field, record || ':' || field || chr(9) || name || chr(9) || value AS text FROM c WHERE contains(value, '{NEEDLE}')",
    "contains_a1_report": f"WITH {_PART}, {_CELLS} SELECT record, field, record || ':' || field || '@L' || record || ' [' || chr(64 + field) || (record + 1) || ']' || chr(9) || name || chr(9) || value AS text FROM c WHERE contains(value, '{NEEDLE}')",
    "contains_filter": f"WITH {_PART} SELECT * FROM t WHERE contains(p_name, '{NEEDLE}') OR contains(p_brand, '{NEEDLE}') OR contains(p_type, '{NEEDLE}')",
    "contains_column": f"WITH {_PART} SELECT * FROM t WHERE contains(p_type, '{NEEDLE}')",
    "contains_row": f"WITH {_PART}, {_CELLS} SELECT record, field, value FROM c WHERE record = 7 AND contains(value, 'a')",
    "contains_cell": f"WITH {_PART}, {_CELLS} SELECT record, field, value FROM c WHERE record = 7 AND field = 2 AND contains(value, '#')",
    "normalize_contains": f"WITH {_DOCS} SELECT record, 1 AS field FROM d WHERE contains(nfc_normalize(text), nfc_normalize('e' || chr(769) || 'a'))",
    "include_headers": f"WITH {_PART}, {_CELLS} SELECT 0 AS record, field, '0:' || field || chr(9) || name || chr(9) || name AS text FROM (SELECT DISTINCT field, name FROM c) WHERE contains(name, 'p_') UNION ALL SELECT record, field, record || ':' || field || chr(9) || name || chr(9) || value FROM c WHERE contains(value, 'p_')",
    "context_abc": "WITH t AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS record, o_orderstatus s, o_orderpriority p FROM orders), h AS (SELECT record FROM t WHERE (contains(s, 'URGENT') OR contains(p, 'URGENT'))), k AS (SELECT t.record, bool_or(t.record = h.record) AS match FROM t JOIN h ON t.record BETWEEN h.record - 1 AND h.record + 2 GROUP BY t.record) SELECT record, match, coalesce(record - lag(record) OVER (ORDER BY record) > 1, false) AS gap FROM k",
    "head_records": f"WITH {_PART} SELECT * FROM t WHERE record <= 25",
    "tail_records": f"WITH {_PART} SELECT * FROM t WHERE record > (SELECT count(*) FROM t) - 25",
    "mid_records": f"WITH {_PART} SELECT * FROM t WHERE record BETWEEN 11 AND 40",
    "get_cell": f"WITH {_PART} SELECT p_brand AS value FROM t WHERE record = 5",
    "count_records": "SELECT count(*) AS records FROM lineitem",
    "rownum": f"WITH {_PART} SELECT record, record || ',' || {_QUOTE.format('p_name')} || ',' || {_QUOTE.format('p_brand')} || ',' || {_QUOTE.format('p_type')} AS text FROM t",
    "csv_encode": f"WITH {_DOCS} SELECT record, {_QUOTE.format('text')} || ',' || {_QUOTE.format('lang')} AS text FROM d",
    "two_header_encode": f"WITH {_DOCS}, e AS (SELECT record, {_TWO} AS v FROM d) SELECT record, {_QUOTE.format('v')} AS text FROM e",
    "hash_sha256": "SELECT row_number() OVER (ORDER BY c_custkey) AS record, sha256(c_name) AS c_name, c_mktsegment FROM customer",
    "hmac_sha256": f"SELECT row_number() OVER (ORDER BY c_custkey) AS record, sha256({_OUT} || from_hex(sha256({_IN} || encode(c_name)))) AS c_name FROM customer",
    "encrypt_roundtrip": "SELECT row_number() OVER (ORDER BY s_suppkey) AS record, s_name FROM supplier",
    "edit_insert": f"WITH {_PART} {_EDIT} UNION ALL SELECT 3, 0, 0, 'x', 'y', 'z' UNION ALL SELECT 3, 0, 1, 'p,q', 'r', 's'",
    "edit_append": f"WITH {_PART} {_EDIT} UNION ALL SELECT (SELECT count(*) FROM t) + 1, 2, 0, 'x', 'y', 'z'",
    "edit_delete": f"WITH {_PART} {_EDIT} WHERE NOT (record BETWEEN 2 AND 5 OR record >= 10)",
    "edit_blank": f"WITH {_PART} SELECT record AS \"order\", 1 AS phase, 0 AS seq, p_name, p_brand, CASE WHEN record = 4 THEN '' ELSE p_type END AS p_type FROM t",
    "edit_update": f"WITH {_PART} SELECT record AS \"order\", 1 AS phase, 0 AS seq, CASE WHEN record = 6 THEN 'other' ELSE p_name END AS p_name, p_brand, CASE WHEN record = 4 THEN 'new' ELSE p_type END AS p_type FROM t",
    "edit_drop_column": f"WITH {_PART} SELECT record AS \"order\", 1 AS phase, 0 AS seq, p_name, p_type FROM t",
    "edit_add_column": f"WITH {_PART} SELECT record AS \"order\", 1 AS phase, 0 AS seq, p_name, 'v' AS extra, p_brand, p_type FROM t",
    "edit_batch": f"WITH {_PART} SELECT record AS \"order\", 1 AS phase, 0 AS seq, CASE WHEN record = 9 THEN 'u' ELSE p_name END AS p_name, CASE WHEN record = 9 THEN '' ELSE p_brand END AS p_brand, p_type FROM t WHERE record NOT BETWEEN 5 AND 6 UNION ALL SELECT 3, 0, 0, 'x', 'y', 'z' UNION ALL SELECT (SELECT count(*) FROM t) + 1, 2, 0, 'l', 'm', 'n'",
    "edit_update_where": "WITH t AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS record, n_name FROM nation) SELECT record, CASE WHEN record = 3 THEN 'changed' ELSE n_name END AS n_name FROM t",
    "dry_run_changes": f"WITH {_PART} SELECT record, 3 AS field, 'p_type' AS \"column\", p_type AS old, 'new' AS new FROM t WHERE record = 4 UNION ALL SELECT record, 1, 'p_name', p_name, 'other' FROM t WHERE record = 6",
    "json_records": "SELECT record, '{\"record\":' || record || ',\"line\":' || record || ',\"fields\":{\"n_nationkey\":\"' || n_nationkey || '\",\"n_name\":\"' || n_name || '\"}}' AS text FROM (SELECT row_number() OVER (ORDER BY n_nationkey) AS record, n_nationkey, n_name FROM nation)",
    "json_cell_hits": "WITH t AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS record, n_nationkey::VARCHAR AS a, n_name AS b FROM nation), c AS (SELECT record, 1 AS field, 'n_nationkey' AS name, a AS value FROM t UNION ALL SELECT record, 2, 'n_name', b FROM t) SELECT record, field, '{\"record\":' || record || ',\"field\":' || field || ',\"header_en\":\"' || name || '\",\"value\":\"' || value || '\",\"line\":' || record || '}' AS text FROM c WHERE contains(value, '1')",
    "max_display_width": "SELECT max(length(n_name)) AS width FROM nation",
    "page_window": "SELECT record, o_orderkey FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS record, o_orderkey FROM orders) WHERE record BETWEEN 90 AND 130",
    "markdown_cells": f"WITH {_DOCS}, m AS (SELECT record, {_MARKDOWN} AS c FROM d), h AS (SELECT record, CASE WHEN left(c, 1) = ' ' THEN '\\x20' || substr(c, 2) ELSE c END AS c FROM m), e AS (SELECT record, CASE WHEN right(c, 1) = ' ' THEN left(c, length(c) - 1) || '\\x20' ELSE c END AS c FROM h) SELECT record, CASE WHEN regexp_full_match(trim(c), '[-:]*-[-:]*') THEN CASE WHEN left(c, 1) = '-' THEN '\\x2D' ELSE '\\x3A' END || substr(c, 2) ELSE c END AS cell FROM e",
    "file_scan": f"WITH {_PART} SELECT record, record + 1 AS line, p_name, p_brand, p_type FROM t",
    "file_scan_quoted": f"WITH {_DOCS}, n AS (SELECT record, text, lang, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM d) SELECT record, CAST(2 + coalesce(sum(lines) OVER (ORDER BY record ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line, text, lang FROM n",
    "file_two_header": f"WITH {_DOCS} SELECT record, record + 2 AS line, text, lang FROM d",
    "file_lines": f"WITH {_PART} SELECT record, record AS line, p_name AS value FROM t",
    "file_window": f"WITH {_PART} SELECT record, record + 1 AS line, p_name FROM t WHERE record <= 5 OR record BETWEEN 11 AND 40 OR record > (SELECT count(*) FROM t) - 5",
    "file_get": f"WITH {_PART} SELECT p_brand || chr(10) AS value FROM t WHERE record = 5",
    "file_search": f"WITH {_PART}, {_CELLS} SELECT record, field, record || ':' || field || '@L' || (record + 1) || chr(9) || name || chr(9) || value AS text FROM c WHERE contains(value, '{NEEDLE}')",
    "file_search_nothing": f"WITH {_PART}, {_CELLS} SELECT record, field, value AS text FROM c WHERE false",
    "file_append": f"WITH {_PART} SELECT * FROM t UNION ALL SELECT (SELECT count(*) FROM t) + 1, 'x', 'y', 'z' UNION ALL SELECT (SELECT count(*) FROM t) + 2, 'l', 'm,n', 'o'",
    "file_edit": f"WITH {_PART}, e AS (SELECT record AS o, 1 AS p, CASE WHEN record = 9 THEN 'u,v' ELSE p_name END AS p_name, CASE WHEN record = 9 THEN '' ELSE p_brand END AS p_brand, p_type FROM t WHERE record NOT BETWEEN 5 AND 6 UNION ALL SELECT 3, 0, 'x', 'y', 'z' UNION ALL SELECT (SELECT count(*) FROM t) + 1, 2, 'l', 'm', 'n'), n AS (SELECT row_number() OVER (ORDER BY o, p) AS record, p_name, p_brand, p_type FROM e) SELECT record, record + 1 AS line, p_name, p_brand, p_type FROM n",
    "file_edit_keeps_bytes": f"WITH {_PART} SELECT record, '\"' || p_name || '\",v,' || CASE WHEN record = 2 THEN 'new' ELSE '\"' || p_brand || '\"' END || ',\"' || p_type || '\"' AS text FROM t",
    "file_final_newline": "SELECT * FROM (VALUES ('update', false), ('delete', false), ('delete the last', true)) AS v(edit, feed)",
    "file_index_seek": f"WITH {_PART} SELECT record, record + 1 AS line, p_name, p_brand, p_type FROM t WHERE record BETWEEN 101 AND 120",
    "file_encrypted": "SELECT row_number() OVER (ORDER BY s_suppkey) AS record, s_name, s_nationkey::VARCHAR AS s_nationkey FROM supplier",
    "file_markdown": f"WITH {_NATION} SELECT record, n_nationkey, CASE WHEN record = 3 THEN 'a|b' ELSE n_name END AS n_name FROM t",
    "standard_input": f"WITH {_NATION} SELECT record || ',' || n_nationkey || ',' || n_name AS text FROM t WHERE contains(n_nationkey, '1') OR contains(n_name, '1')",
    "streaming_search": "SELECT p_name AS value FROM part WHERE contains(p_name, 'an')",
    "search_reasons": f"WITH {_PART} SELECT record, contains(p_type, '{NEEDLE}') AS emitted, CASE WHEN contains(p_type, '{NEEDLE}') THEN 'a cell holds the needle' ELSE 'no cell holds the needle' END AS reason FROM t",
    "page_wrap": "WITH t AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS record, n_name FROM nation) SELECT (record - 20 + 25) % 25 AS place, record, n_name FROM t WHERE (record - 20 + 25) % 25 < 10",
}
