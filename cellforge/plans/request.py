"""A request, and the rules that refuse combinations which would be a guess. No job runs before they pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields

from ..model import EngineError, Format

VALUES = {"update", "update_where", "insert", "append", "contains", "add_column", "create"}


@dataclass
class Request:
    input: str | None = None
    stdin: bool = False
    output: str | None = None
    stdout: bool = False
    in_place: bool = False
    backup: bool = False
    dry_run: bool = False
    create: list | bool = False  # the title rows
    trace: bool = False
    log: str | None = None
    count: bool = False
    build_index: bool = False
    verify_index: bool = False
    no_index: bool = False
    headers: int | None = None
    head: int | None = None
    tail: int | None = None
    mid: tuple[int | None, int | None] | None = None
    get: tuple[int, str] | None = None
    contains: str | None = None
    filter: bool = False
    normalize: bool = False
    include_headers: bool = False
    search_record: int | None = None
    search_column: str | None = None
    search_cell: tuple[int, str] | None = None
    before: int = 0
    after: int = 0
    json: bool = False
    json_ascii: bool = False
    markdown: bool = False
    md_table: int | None = None
    md_style: str | None = None
    pretty: bool = False
    titles: bool = False
    rownum: bool = False
    physical: bool = False
    a1: bool = False
    english: bool = False
    chinese: bool = False
    insert: list = field(default_factory=list)
    append: list = field(default_factory=list)
    delete: list = field(default_factory=list)
    delete_cell: list = field(default_factory=list)
    drop_column: list = field(default_factory=list)
    add_column: list = field(default_factory=list)
    update: list = field(default_factory=list)
    update_where: list = field(default_factory=list)
    value_file: str | None = None
    value_stdin: bool = False
    hash: str | None = None
    encrypt: str | None = None
    decrypt: str | None = None
    keyfile: str | None = None
    truncate_partial: bool = False

    def __repr__(self) -> str:
        """Values are never shown: they may be what a column protects."""
        shown = ((f.name, getattr(self, f.name)) for f in fields(self))
        return "Request(" + ", ".join(f"{k}={'<value>' if k in VALUES else v!r}" for k, v in shown if v not in (None, False, 0, [])) + ")"

    @property
    def edits(self) -> bool:
        return any((self.insert, self.append, self.delete, self.delete_cell, self.drop_column, self.add_column, self.update, self.update_where))

    @property
    def transforms(self) -> bool:
        return any((self.hash, self.encrypt, self.decrypt))

    @property
    def selects(self) -> bool:
        return any(v is not None for v in (self.head, self.tail, self.mid, self.get, self.contains))

    @property
    def scopes(self) -> int:
        return sum(v is not None for v in (self.search_record, self.search_column, self.search_cell))

    @property
    def shapes(self) -> bool:
        return self.json or self.markdown or self.rownum or self.titles or self.pretty

    @property
    def context(self) -> bool:
        return bool(self.before or self.after)

    @property
    def from_markdown(self) -> bool:
        return bool(self.input and self.input.lower().endswith(".md"))

    @property
    def to_markdown(self) -> bool:
        return bool(self.output and self.output.lower().endswith(".md"))

    @property
    def format(self) -> Format:
        return Format.of(self.input or "")

    @property
    def searched_record(self) -> int | None:
        return self.search_cell[0] if self.search_cell else self.search_record


Rule = tuple[Callable[[Request], object], str, str]
_verbs = lambda r: r.edits or r.transforms

#: Each: when it applies, then the two messages.
RULES: list[Rule] = [
    (lambda r: r.create is True, "-create needs one title row, or two", "-create 需要一列或兩列標題"),
    (lambda r: r.create and not r.output, "-create needs -o", "-create 需要 -o"),
    (lambda r: r.create and (r.input or r.stdin or _verbs(r) or r.selects or r.shapes or r.count or r.in_place), "-create goes with -o alone", "-create 只能搭配 -o"),
    (lambda r: r.count and (_verbs(r) or r.selects or r.shapes or r.output or r.in_place or r.filter), "-count goes alone", "-count 必須單獨使用"),
    (lambda r: r.input and r.stdin, "-i and -si name two inputs", "-i 與 -si 指定了兩個輸入"),
    (lambda r: r.output and r.stdout, "-o and -so name two outputs", "-o 與 -so 指定了兩個輸出"),
    (lambda r: r.output and r.in_place, "-o and --in-place name two outputs", "-o 與 --in-place 指定了兩個輸出"),
    (lambda r: r.stdout and r.in_place, "-so and --in-place name two outputs", "-so 與 --in-place 指定了兩個輸出"),
    (lambda r: r.backup and not r.in_place, "--backup needs --in-place", "--backup 需要 --in-place"),
    (lambda r: r.backup and r.dry_run, "--dry-run writes nothing to back up", "--dry-run 不寫任何東西，無需備份"),
    (lambda r: r.build_index and r.verify_index, "build and verify are two requests", "建立與驗證索引是兩件事"),
    (lambda r: (r.build_index or r.verify_index) and (_verbs(r) or r.selects), "an index request goes with neither edits nor selections", "索引不能與編輯或選取並用"),
    (lambda r: (r.build_index or r.verify_index) and r.no_index, "--no-index contradicts an index request", "--no-index 與索引請求相矛盾"),
    (lambda r: (r.build_index or r.verify_index) and not r.input, "an index needs -i", "索引需要 -i"),
    (lambda r: r.get and (_verbs(r) or r.head is not None or r.tail is not None or r.mid or r.contains is not None), "-get goes with neither edits, transforms nor selections", "-get 不能與編輯、轉換或選取並用"),
    (lambda r: r.get and r.shapes, "-get prints one cell in no shape", "-get 只輸出一格，沒有形狀"),
    (lambda r: r.get and r.get[0] < 1, "-get: records count from 1", "-get 的筆數從 1 起"),
    (lambda r: r.get and r.output and Format.of(r.output) is not Format.LINES, "one cell is not a table file", "單一儲存格不是表格檔"),
    (lambda r: r.include_headers and r.contains is None, "--include-headers needs -contains", "--include-headers 需要 -contains"),
    (lambda r: r.filter and r.contains is None, "--filter needs -contains", "--filter 需要 -contains"),
    (lambda r: r.normalize and r.contains is None, "--normalize needs -contains", "--normalize 需要 -contains"),
    (lambda r: r.scopes and r.contains is None, "a search scope needs -contains", "搜尋範圍需要 -contains"),
    (lambda r: r.context and r.contains is None, "-A, -B and -C need -contains", "-A、-B、-C 需要 -contains"),
    (lambda r: r.before < 0 or r.after < 0, "context counts from 0", "前後文筆數從 0 起"),
    (lambda r: r.contains == "", "an empty search string matches everything", "空的搜尋字串會符合一切"),
    (lambda r: r.truncate_partial and r.append, "--truncate-partial would hide what -append must see", "--truncate-partial 不能與 -append 並用"),
    (lambda r: not r.create and not r.input and not r.stdin, "there is no input", "沒有輸入"),
    (lambda r: r.stdin and r.headers is None, "standard input has no suffix: say --headers", "標準輸入沒有副檔名，請指定 --headers"),
    (lambda r: r.headers not in (None, 0, 1, 2), "--headers takes 0, 1 or 2", "--headers 只接受 0、1 或 2"),
    (lambda r: r.headers and r.input and not r.from_markdown and r.format is not Format.LINES and r.headers != r.format.header_rows, "--headers disagrees with the suffix", "--headers 與副檔名不符"),
    (lambda r: r.headers and r.from_markdown, "a Markdown table brings its own headers", "Markdown 表格自帶標頭"),
    (lambda r: r.head is not None and r.tail is not None, "-head and -tail are two selections", "-head 與 -tail 不能並用"),
    (lambda r: r.mid and (r.head is not None or r.tail is not None), "-mid goes with neither -head nor -tail", "-mid 不能與 -head 或 -tail 並用"),
    (lambda r: r.head is not None and r.head < 1, "-head takes a number from 1 up", "-head 至少為 1"),
    (lambda r: r.tail is not None and r.tail < 1, "-tail takes a number from 1 up", "-tail 至少為 1"),
    (lambda r: r.mid and r.mid[0] and r.mid[1] and r.mid[0] > r.mid[1], "-mid: the range is empty", "-mid 的範圍是空的"),
    (lambda r: r.markdown and r.json, "-md and --json are two shapes", "-md 與 --json 是兩種形狀"),
    (lambda r: r.drop_column and not r.from_markdown and r.input and r.format is Format.LINES and not r.headers, "lines have no columns to drop", "純文字行沒有欄位可刪"),
    (lambda r: r.drop_column and (r.insert or r.append), "-delete -col goes with neither -insert nor -append", "-delete -col 不能與 -insert 或 -append 並用"),
    (lambda r: r.drop_column and r.add_column, "-delete -col does not go with -add-column", "-delete -col 不能與 -add-column 並用"),
    (lambda r: r.md_table is not None and not r.from_markdown, "--md-table needs a Markdown input", "--md-table 需要 Markdown 輸入"),
    (lambda r: r.markdown and not r.titles, "a Markdown table has a header: -md needs -t", "Markdown 表格有標頭：-md 需要 -t"),
    (lambda r: r.to_markdown and not r.markdown, "a .md file is written with -md", ".md 檔要用 -md 寫出"),
    (lambda r: r.edits and r.selects, "edits do not go with selections", "編輯不能與選取並用"),
    (lambda r: r.edits and not (r.output or r.stdout or r.in_place or r.dry_run), "an edit needs a destination", "編輯需要輸出位置"),
    (lambda r: r.edits and r.json, "an edit writes a table, not JSON", "編輯輸出表格而非 JSON"),
    (lambda r: r.edits and r.markdown and not (r.to_markdown or r.from_markdown), "an edit with -md needs a Markdown target", "編輯搭配 -md 需要 Markdown 目標"),
    (lambda r: r.value_file and r.value_stdin, "--value-file and --value-stdin are two sources", "--value-file 與 --value-stdin 是兩個來源"),
    (lambda r: r.value_stdin and r.stdin, "standard input cannot be both table and value", "標準輸入不能同時是表格與值"),
    (lambda r: (r.value_file or r.value_stdin) and len(r.update) != 1, "a value source goes with exactly one -update", "值來源只能搭配一個 -update"),
    (lambda r: (r.value_file or r.value_stdin) and r.update and len(r.update[0]) > 2 and r.update[0][2] is not None, "a value source replaces the literal value", "值來源不能與字面值並用"),
    (lambda r: r.trace and r.contains is None, "a trace tells why a search took a record or not: it needs -contains", "追蹤說明搜尋為何取用某筆，需要 -contains"),
    (lambda r: r.log and r.log in (r.input, r.output, r.keyfile, r.value_file), "the log is one of the files at work", "日誌檔與處理中的檔案相同"),
    (lambda r: r.dry_run and not r.edits, "--dry-run needs an edit", "--dry-run 需要編輯"),
    (lambda r: r.dry_run and any((r.insert, r.append, r.delete, r.delete_cell, r.drop_column, r.add_column)), "--dry-run goes with -update and -update-where only", "--dry-run 只與 -update、-update-where 並用"),
    (lambda r: r.update_where and r.stdin, "-update-where reads the file twice: it needs -i", "-update-where 要讀兩次檔案，需要 -i"),
    (lambda r: r.keyfile and r.keyfile in (r.output, r.input if r.in_place else None), "the output would replace the key file", "輸出會覆蓋金鑰檔"),
    (lambda r: r.output and r.output == r.input, "-o names the input: say --in-place", "-o 與輸入相同，請用 --in-place"),
    (lambda r: r.in_place and not r.input, "--in-place needs a file", "--in-place 需要檔案"),
    (lambda r: r.in_place and r.selects, "--in-place would lose what is not selected", "--in-place 會遺失未選取的部分"),
    (lambda r: r.in_place and not _verbs(r), "--in-place needs an edit", "--in-place 需要編輯"),
    (lambda r: r.output == "", "-o is empty", "-o 是空的"),
    (lambda r: r.output and not r.to_markdown and Format.of(r.output) is not Format.LINES and not r.create and not r.edits and (not r.titles or r.json or r.markdown or r.rownum or (r.contains is not None and not r.filter and not r.context)), "a table file holds header rows and records: -t and no other shape", "表格檔需要 -t，且不能是其他形狀"),
    (lambda r: r.output and not r.to_markdown and not r.create and Format.of(r.output) is not Format.LINES and r.input and not r.from_markdown and Format.of(r.output).header_rows != (r.format.header_rows if r.headers is None else r.headers), "input and output differ in header rows", "輸入與輸出的標頭列數不同"),
    (lambda r: (r.physical or r.a1) and (r.contains is None or r.filter or r.context or r.markdown or r.json), "--physical and --a1 belong to the locating report", "--physical 與 --a1 屬於定位報告"),
    (lambda r: r.pretty and r.md_style, "--pretty and --md-style are two styles", "--pretty 與 --md-style 是兩種樣式"),
    (lambda r: r.pretty and not r.markdown, "--pretty needs -md", "--pretty 需要 -md"),
    (lambda r: r.md_style and not r.markdown, "--md-style needs -md", "--md-style 需要 -md"),
    (lambda r: r.md_style not in (None, "preserve", "compact"), "--md-style takes preserve or compact", "--md-style 只接受 preserve 或 compact"),
    (lambda r: r.english and r.chinese, "--en and --zh are two languages", "--en 與 --zh 不能並用"),
    (lambda r: r.rownum and r.json, "--json names fields and has no place for -rownum", "--json 沒有 -rownum 的位置"),
    (lambda r: r.json_ascii and not r.json, "--json-ascii needs --json", "--json-ascii 需要 --json"),
    (lambda r: r.scopes > 1, "one search scope at a time", "一次只能有一個搜尋範圍"),
    (lambda r: r.head is not None and r.searched_record is not None and r.searched_record > r.head, "the search scope lies outside -head", "搜尋範圍在 -head 之外"),
    (lambda r: r.mid and r.searched_record is not None and not ((r.mid[0] or 1) <= r.searched_record <= (r.mid[1] or r.searched_record)), "the search scope lies outside -mid", "搜尋範圍在 -mid 之外"),
    (lambda r: sum(v is not None for v in (r.hash, r.encrypt, r.decrypt)) > 1, "one of -hash, -encrypt and -decrypt at a time", "-hash、-encrypt、-decrypt 一次一個"),
    (lambda r: (r.encrypt or r.decrypt) and not r.keyfile, "-encrypt and -decrypt need -keyfile", "-encrypt 與 -decrypt 需要 -keyfile"),
]


def validate(request: Request) -> Request:
    """The request, or the first rule that refuses it."""
    for applies, message, message_zh in RULES:
        if applies(request):
            raise EngineError("usage", message, message_zh)
    return request
