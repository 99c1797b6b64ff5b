"""The byte-exact file path: reading without a split, cells that keep their bytes, line ends, standard input, indexes."""

import io
import os

import pytest
from pyspark.sql import functions as F

from cellforge.model import TWO_HEADER, EngineError, Format
from cellforge.operators import edit as E
from cellforge.operators import protect, select
from cellforge.plans.request import Request
from cellforge.plans.run import run
from cellforge.sources import index, sinks
from cellforge.sources.columnar import shape_of
from cellforge.sources.parser import check_width, parse_stretch
from cellforge.sources.table import StrictReader, open_table


def out(spark, given=b"", **kw):
    return b"".join(run(spark, Request(**kw), io.BytesIO(given)))


def file(tmp_path, data, name="t.csv"):
    (tmp_path / name).write_bytes(data)
    return str(tmp_path / name)


def refused(spark, **kw):
    with pytest.raises(EngineError) as e:
        out(spark, **kw)
    return e.value.code


def test_nothing_left_to_read(spark, tmp_path):
    only, some = file(tmp_path, b"a,b\n", "h.csv"), file(tmp_path, b"a,b\n1,2\n")
    for kw in ({}, {"contains": "x"}, {"contains": "x", "filter": True}, {"head": 3}, {"tail": 3}, {"contains": "x", "after": 1}):
        assert out(spark, input=only, **kw) == b""
    assert out(spark, input=only, count=True) == b"0\n" and open_table(spark, only).df.count() == 0
    assert out(spark, input=only, json=True).endswith(b'{"meta":{"records":0,"matched":0}}\n')
    assert refused(spark, input=some, get=(7, "a")) == refused(spark, input=some, contains="2", search_record=7) == refused(spark, input=some, mid=(2, None)) == "out-of-range"
    assert open_table(spark, some).narrowed(5).df.collect() == open_table(spark, some).df.where("record > 5").collect() == []
    for name in ("e.csv", "e.txt"):
        empty = file(tmp_path, b"", name)
        assert refused(spark, input=empty) == "malformed" if name == "e.csv" else out(spark, input=empty) == b""


def test_columnar_reading_equals_the_walk():
    import random

    rng, seen = random.Random(1), 0
    pick = lambda chars, most: "".join(rng.choice(chars) for _ in range(rng.randint(0, most)))

    def cell(format):
        k = rng.random()
        if k < 0.6:
            return pick("ab xn", 3)
        if k < 0.8:
            return '"' + pick(["a", ",", '""', "\n" if format is Format.CSV else "q", " ", "\r"], 4) + '"'
        return rng.choice(["\\n", "\\\\", "a\\\\n", 'a"b', "\r", "\\q", '"x"y', "a\rb", "", " a", "b\t", "|---|"])

    for _ in range(6000):
        format, width = rng.choice(list(Format)), rng.choice([1, 2, 3])
        data = "".join(",".join(cell(format) for _ in range(width + (rng.random() < 0.01))) + rng.choice(["\n", "\n", "\r\n"]) for _ in range(rng.randint(0, 5))).encode()
        data = data[: len(data) - (rng.random() < 0.3)]
        shape = shape_of(data, format, True, width)
        if shape is None:
            continue
        rows = list(parse_stretch(data, format))
        for r in rows:
            check_width(r.fields, 1 if format is Format.LINES else width, r.number, r.line)
        cut = rng.randint(0, len(rows))
        got = [list(zip(*(x.to_pylist() for x in shape.arrays(a, b)), strict=True)) for a, b in ((0, cut), (cut, len(rows))) if a < b]
        assert [x for part in got for x in part] == [(r.fields, r.raws(format)) for r in rows]
        assert (shape.lines() + 1).tolist() == [r.line for r in rows] and shape.starts[shape.first[:-1]].tolist() == [r.offset for r in rows]
        seen += len(rows)
    assert seen > 5000


QUOTED = b'a,b,c\n"1",x,"y"\n"2","p,q",z\n3,4,5\n'


@pytest.mark.parametrize(
    ("edit", "want"),
    [
        ({"update": [(1, "b", "q")]}, b'a,b,c\n"1",q,"y"\n"2","p,q",z\n3,4,5\n'),
        ({"update": [(2, "b", "")]}, b'a,b,c\n"1",x,"y"\n"2",,z\n3,4,5\n'),
        ({"delete_cell": [(2, "a")]}, b'a,b,c\n"1",x,"y"\n,"p,q",z\n3,4,5\n'),
        ({"drop_column": ["b"]}, b'a,c\n"1","y"\n"2",z\n3,5\n'),
        ({"add_column": [(2, "n", "0")]}, b'a,n,b,c\n"1",0,x,"y"\n"2",0,"p,q",z\n3,0,4,5\n'),
        ({"insert": [(2, 'i,"j","k,l"')], "delete": [(2, 3)]}, b'a,b,c\n"1",x,"y"\ni,j,"k,l"\n'),
        ({"hash": "b"}, b'a,b:hash,c\n"1",2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881,"y"\n'),
    ],
)
def test_cells_keep_their_bytes(spark, tmp_path, edit, want):
    for kw in ({"in_place": True}, {"output": str(tmp_path / "o.csv"), "titles": True}):
        path = file(tmp_path, QUOTED)
        out(spark, input=path, **kw, **edit)
        assert open(kw.get("output", path), "rb").read().startswith(want)


def test_many_edits_keep_bytes_and_order(spark, tmp_path):
    path = file(tmp_path, b"a,b\n" + b"".join(b'"%d",x\n' % i for i in range(1, 401)))
    t = open_table(spark, path, split_bytes=256)
    sinks.write_table(E.edited(t, E.Edits(update=[(i, 2, b"n%d" % i) for i in range(1, 301)], insert=[(i, b"i,%d" % i) for i in range(1, 401, 100)])), path)
    want = [line for i in range(1, 401) for line in ([b"i,%d" % i] if i % 100 == 1 else []) + [b'"%d",%s' % (i, b"n%d" % i if i <= 300 else b"x")]]
    assert open(path, "rb").read() == b"a,b\n" + b"\n".join(want) + b"\n"


@pytest.mark.parametrize(
    ("data", "edit", "want"),
    [
        (b"a,b\n1,x\n2,y", {"update": [(1, "a", "9")]}, b"a,b\n9,x\n2,y"),
        (b"a,b\n1,x\n2,y", {"update": [(2, "a", "9")]}, b"a,b\n1,x\n9,y"),
        (b"a,b\n1,x\n2,y", {"delete": [(2, 2)]}, b"a,b\n1,x\n"),
        (b"a,b\n1,x\n2,y", {"append": ["3,z"]}, b"a,b\n1,x\n2,y\n3,z\n"),
        (b"a,b\n1,x\n2,y", {"insert": [(2, "3,z")]}, b"a,b\n1,x\n3,z\n2,y"),
        (b"a,b\n1,x\n2,y", {"insert": [(2, "3,z")], "delete": [(2, 2)]}, b"a,b\n1,x\n3,z\n"),
        (b"a\n1\nx", {"update": [(2, "a", "")]}, b"a\n1\n\n"),
        (b"a,b\n1,x", {"hash": "b"}, b"a,b:hash\n1,2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881\n"),
    ],
)
def test_the_final_line_feed(spark, tmp_path, data, edit, want):
    for kw in ({"in_place": True}, {"output": str(tmp_path / "o.csv"), "titles": True}):
        path = file(tmp_path, data)
        out(spark, input=path, **kw, **edit)
        got = open(kw.get("output", path), "rb").read()
        assert got == want
    assert out(spark, input=file(tmp_path, data), **edit, titles=True, stdout=True) == got


def test_a_markdown_line_in_a_csv_file(spark, tmp_path):
    for data in (b"a\n|---|\nx\n", b"a\nx\n|:--|--|\r\n", b"a,b\n1,2\n|---|\n"):
        assert refused(spark, input=file(tmp_path, data)) == "malformed"
    assert out(spark, input=file(tmp_path, b"a\n|--|\n")) == b"|--|\n"


def test_standard_input(spark, tmp_path):
    data = b'a,b\r\n"1",x\r\n2,y'
    assert out(spark, data, stdin=True, headers=1, titles=True) == b'a,b\n"1",x\n2,y\n'
    assert out(spark, data, stdin=True, headers=1, contains="y") == b"2:2\tb\ty\n"
    assert out(spark, data, stdin=True, headers=1, count=True) == b"2\n"
    assert out(spark, data, stdin=True, headers=1, update=[(1, "b", "q")], stdout=True) == b'a,b\n"1",q\n2,y'
    assert out(spark, b"l1\n\nl3", stdin=True, headers=0) == b"l1\n\nl3\n"
    path = file(tmp_path, b"a,b\n1,x\n")
    out(spark, b"two\nlines,", input=path, update=[(1, "b", None)], value_stdin=True, in_place=True)
    assert open(path, "rb").read() == b'a,b\n1,"two\nlines,"\n'
    value = file(tmp_path, b"\xff", "v.bin")
    out(spark, input=path, update=[(1, "b", None)], value_file=value, in_place=True)
    assert open(path, "rb").read() == b"a,b\n1,\xff\n"
    assert refused(spark, input=path, update=[(1, "b", None)], value_file=str(tmp_path), in_place=True) == "usage"


def test_create_as_a_request(spark, tmp_path):
    path = str(tmp_path / f"n.{TWO_HEADER}")
    out(spark, create=["a,b", "甲,乙"], output=path)
    assert open(path, "rb").read() == "a,b\n甲,乙\n".encode()
    assert refused(spark, create=["a,b", "甲,乙"], output=path) == "exists"
    assert refused(spark, create=True, output=path) == refused(spark, create=["a,b"], output=str(tmp_path / "m.txt")) == "usage"


def test_markdown_output_styles(spark, tmp_path):
    doc = b"|  a | b |\n|----|:--|\n| 1  | x |\n|1|x|\n| 2 |y|\n"
    path = file(tmp_path, doc, "d.md")
    assert out(spark, input=path, markdown=True, titles=True, md_style="preserve") == doc
    assert out(spark, input=path, markdown=True, titles=True) == b"|a|b|\n|---|---|\n|1|x|\n|1|x|\n|2|y|\n"
    assert out(spark, input=path, markdown=True, titles=True, rownum=True, head=1) == b"|rownum|a|b|\n|---|---|---|\n|1|1|x|\n"
    two = file(tmp_path, "a,b\n甲,乙\n1,2\n".encode(), f"t.{TWO_HEADER}")
    assert out(spark, input=two, markdown=True, titles=True, rownum=True).decode().startswith("|rownum<br>列號|a<br>甲|b<br>乙|\n")
    assert out(spark, input=two, markdown=True, titles=True, chinese=True).decode().startswith("|甲|乙|\n")


def test_refusals_keep_their_code_through_tasks(spark, tmp_path):
    path = file(tmp_path, b"a,b\n1,2\n3\n")
    with pytest.raises(EngineError) as e:
        out(spark, input=path)
    assert e.value.code == "ragged" and "record 2 (line 3)" in e.value.message and "第 2 筆" in e.value.message_zh
    assert refused(spark, input=file(tmp_path, b'a,b\n1,"2"x\n'), contains="zz") == "malformed"
    assert refused(spark, input=file(tmp_path, b"a,b\n1,\xff\n"), json=True) == "malformed"
    file(tmp_path, b"a,b\n1,2\n3\n")
    assert refused(spark, input=path, in_place=True, update=[(1, "a", "x")]) == "ragged" and os.listdir(tmp_path) == ["t.csv"]


def test_addresses_with_claims(spark, tmp_path):
    data = b'a,b\n"x\ny",1\n2,3\n'
    path = file(tmp_path, data)
    out(spark, input=path, in_place=True, update=[(2, "b@L4 [B3]", "9")], delete_cell=[(1, "b@L2")])
    assert open(path, "rb").read() == b'a,b\n"x\ny",\n2,9\n'
    for claim in ("b@L3", "b [B4]", "b [A3]"):
        assert refused(spark, input=path, in_place=True, update=[(2, claim, "9")]) == "invalid-address"
        assert refused(spark, input=path, in_place=True, delete_cell=[(2, claim)]) == refused(spark, input=path, get=(2, claim)) == "invalid-address"
        assert refused(spark, input=path, contains="9", search_cell=(2, claim)) == "invalid-address"
    assert out(spark, input=path, contains="9", search_cell=(2, "b@L4")) == b"2:2\tb\t9\n"


def test_an_index_is_kept_up(spark, tmp_path):
    path = file(tmp_path, b"a,b\n" + b"".join(b'%d,"x\ny"\n' % i for i in range(200)))
    index.build(spark, path, split_bytes=256)
    out(spark, input=path, in_place=True, append=["200,z", '201,"p\nq"'])
    assert index.load(path) is not None and index.record_count(spark, path) == 202
    index.verify(spark, path)
    for i in range(40):
        sinks_before = len(index.load(path))
        out(spark, input=path, in_place=True, append=[f"{202 + i},more text here"])
    assert len(index.load(path)) >= sinks_before and index.record_count(spark, path) == 242
    index.verify(spark, path)
    scanned = [(r.record, r.line, bytes(r.fields[0])) for r in open_table(spark, path).df.orderBy("record").collect()]
    assert [(r.record, r.line, bytes(r.fields[0])) for r in index.open_indexed(spark, path).df.orderBy("record").collect()] == scanned
    out(spark, input=path, in_place=True, delete=[(1, 100)])
    assert index.load(path) is not None and index.record_count(spark, path) == 142
    index.verify(spark, path)
    cut = file(tmp_path, b"a,b\n1,2", "cut.csv")
    index.build(spark, cut)
    out(spark, input=cut, in_place=True, append=["3,4"])
    assert open(cut, "rb").read() == b"a,b\n1,2\n3,4\n" and index.record_count(spark, cut) == 2
    index.verify(spark, cut)


@pytest.mark.parametrize("name", ["s.csv", f"s.{TWO_HEADER}"])
def test_search_hands_the_needle_down(spark, tmp_path, name):
    two = name.endswith(TWO_HEADER)
    rows = b"".join(b"%d,%s,z\n" % (i, b"a needle" if i % 50 == 7 else b'"q ""needle"" q"' if i % 50 == 9 else b"hay\\n" if two else b"hay") for i in range(1, 401))
    path = file(tmp_path, b"k,needle,c\n" * (1 + two) + rows, name)
    index.build(spark, path, split_bytes=1024)
    for t in (index.open_indexed(spark, path), open_table(spark, path, split_bytes=512)):
        for needle in ("needle", "q", "no such", "z", 'e"', "\n", "hay"):
            plain = [(r.record, r.field) for r in t.cells().where(F.contains("value", F.lit(needle.encode()))).orderBy("record", "field").collect()]
            assert [(r.record, r.field) for r in select.matches(t, needle).orderBy("record", "field").collect()] == plain, needle
            assert [r.record for r in select.filtered(t, needle).orderBy("record").collect()] == sorted({r for r, _ in plain})
    out_of_width = file(tmp_path, b"a,b\n1,2\n3\n", "w.csv")
    assert refused(spark, input=out_of_width, contains="no such") == "ragged"


def test_a_task_gets_its_own_split_only(spark, tmp_path):
    import json
    import pickle

    plan = {"splits": [[i, i + 1, i, i, 1, 0, 0] for i in range(5000)], "format": "csv", "headers": 1, "width": 1, "size": 9, "widths": True, "truncate": False, "vouched": True}
    reader = StrictReader({"path": "x", "plan": json.dumps(plan)})
    assert len(reader.partitions()) == 4999 and len(pickle.dumps(reader)) < 1000


def test_rows_stay_in_file_order_without_a_sort(spark, tmp_path):
    path = file(tmp_path, b"a\n" + b"".join(b"%d\n" % i for i in range(3000)))
    t = open_table(spark, path, split_bytes=512)
    done = E.edited(t, E.Edits(update=[(5, "a", b"u")], insert=[(9, b"i")], append=[b"l"]))
    plan = sinks.record_lines(done)._jdf.queryExecution().executedPlan().toString()
    assert "Sort " not in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan
    assert out(spark, input=path, head=2000) == b"".join(b"%d\n" % i for i in range(2000))


def test_tracing_and_the_log(spark, tmp_path):
    path, log = file(tmp_path, b"a,b\n1,x\n2,y\n"), str(tmp_path / "a.log")
    assert out(spark, input=path, contains="y", trace=True) == b"record 1 not emitted: no cell holds the needle\nrecord 2 emitted: a cell holds the needle\n"
    out(spark, input=path, in_place=True, update=[(1, "b", "a secret value")], log=log)
    assert refused(spark, input=path, in_place=True, update=[(9, "b", "a secret value")], log=log) == "out-of-range"
    text = open(log).read()
    assert "<value>" in text and "secret" not in text and "1 update" in text and "wrote" in text and "failed: out-of-range" in text


def test_protection_keeps_neighbours(spark, tmp_path):
    secret = b"0123456789abcdef!"
    path, other = file(tmp_path, QUOTED), str(tmp_path / "o.csv")
    sinks.write_table(protect.decrypted(open_table(spark, _sealed(spark, path, secret, tmp_path)), "all", secret), other)
    assert open(other, "rb").read() == b'a,b,c\n"1",x,"y"\n"2","p,q",z\n3,4,5\n'


def _sealed(spark, path, secret, tmp_path):
    sealed = str(tmp_path / "sealed.csv")
    sinks.write_table(protect.encrypted(open_table(spark, path), "b", secret), sealed)
    return sealed


def test_the_first_of_several_faults_is_told(spark, tmp_path, monkeypatch):
    rows = [b"%d,x" % i for i in range(1, 401)]
    rows[120], rows[300], rows[399] = b"121,x,y", b"301", b"400,x,y,z"
    path = file(tmp_path, b"a,b\n" + b"\n".join(rows) + b"\n")
    table = open_table(spark, path, split_bytes=256)
    assert len(table.splits) > 5 and table.faults().count() == 3
    assert table.first_fault().code == "ragged" and "record 121 " in table.first_fault().message
    small = lambda *a, **kw: table
    monkeypatch.setattr(index, "open_indexed", small)
    for kw in ({}, {"contains": "no such"}, {"contains": "x", "filter": True}):
        with pytest.raises(EngineError) as e:
            out(spark, input=path, **kw)
        assert e.value.code == "ragged" and "record 121 (line 122)" in e.value.message
    assert open_table(spark, file(tmp_path, b"a,b\n1,2\n3,4\n", "good.csv"), split_bytes=5).first_fault() is None
