"""Requests over files, end to end, and the pieces they are made of."""

import hashlib
import hmac
import os

import pytest
from pyspark.sql import functions as F

from cellforge.functions import crypto
from cellforge.functions.text import display_width, json_string, markdown_cell, markdown_unescape, report_escape
from cellforge.model import TWO_HEADER, EngineError
from cellforge.operators import edit as E
from cellforge.operators import protect, select
from cellforge.plans.address import Address, parse_range
from cellforge.plans.request import RULES, Request, validate
from cellforge.plans.run import run
from cellforge.sources import index, markdown, sinks
from cellforge.sources.table import open_table

PKGS = "pkg,version,license\n套件,版本,授權\nzlib,1.3.1,MIT\nzstd,1.5.6,BSD\n".encode()


@pytest.fixture
def pkgs(tmp_path):
    p = tmp_path / f"pkgs.{TWO_HEADER}"
    p.write_bytes(PKGS)
    return str(p)


def out(spark, **kw):
    return b"".join(run(spark, Request(**kw))).decode()


def test_reading(spark, pkgs):
    assert out(spark, input=pkgs) == "zlib,1.3.1,MIT\nzstd,1.5.6,BSD\n"
    assert out(spark, input=pkgs, titles=True).encode() == PKGS
    assert out(spark, input=pkgs, get=(1, "license")) == "MIT\n"
    assert out(spark, input=pkgs, count=True) == "2\n"
    assert out(spark, input=pkgs, tail=1, rownum=True) == "2,zstd,1.5.6,BSD\n"
    assert out(spark, input=pkgs, head=1) == "zlib,1.3.1,MIT\n"
    with pytest.raises(EngineError):
        out(spark, input=pkgs, mid=(3, None))


def test_search_reports(spark, pkgs):
    assert out(spark, input=pkgs, contains="MIT") == "1:3\tlicense\tMIT\n"
    assert out(spark, input=pkgs, contains="MIT", a1=True, physical=True) == "1:3@L3 [C3]\tlicense\tMIT\n"
    assert out(spark, input=pkgs, contains="版", include_headers=True) == "0b:2\tversion\t版本\n"
    assert out(spark, input=pkgs, contains="MIT", filter=True) == "zlib,1.3.1,MIT\n"
    assert out(spark, input=pkgs, contains="MIT", chinese=True) == "1:3\t授權\tMIT\n"


def test_json(spark, pkgs):
    want = (
        f'{{"meta":{{"format":"{TWO_HEADER}","headers":2,"fields":3,"header":["pkg","version","license"],"header_zh":["套件","版本","授權"]}}}}\n'
        '{"record":1,"line":3,"fields":{"pkg":"zlib","version":"1.3.1","license":"MIT"}}\n'
        '{"record":2,"line":4,"fields":{"pkg":"zstd","version":"1.5.6","license":"BSD"}}\n'
        '{"meta":{"records":2,"matched":0}}\n'
    )
    assert out(spark, input=pkgs, json=True) == want
    hit = out(spark, input=pkgs, contains="MIT", json=True).splitlines()
    assert hit[1:] == ['{"record":1,"field":3,"header_en":"license","header_zh":"授權","value":"MIT","line":3}', '{"meta":{"records":2,"matched":1}}']
    assert json_string("é😀".encode(), True) == '"\\u00e9\\ud83d\\ude00"'
    with pytest.raises(EngineError):
        json_string(b"\xff")


def test_pretty_markdown(spark, pkgs):
    want = "| pkg<br>套件 | version<br>版本 | license<br>授權 |\n|-------------|-----------------|-----------------|\n| zlib        | 1.3.1           | MIT             |\n| zstd        | 1.5.6           | BSD             |\n"
    assert out(spark, input=pkgs, titles=True, markdown=True, pretty=True) == want


def test_context(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_bytes(b"a\n" + b"".join(b"%s\n" % (b"hit" if i in (3, 9) else b"r%d" % i) for i in range(1, 13)))
    assert out(spark, input=str(p), contains="hit", before=1, after=1) == "r2\nhit\nr4\n--\nr8\nhit\nr10\n"
    assert '"match":true' in out(spark, input=str(p), contains="hit", after=1, json=True)


def test_context_query_takes_every_hit(spark, tmp_path):
    from cellforge import queries

    n, hits = 40, {3, 4, 9, 14, 30, 40}
    rows = [(i * 10, "F", "1-URGENT" if i in hits else "2-HIGH") for i in range(1, n + 1)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted(tuple(r) for r in queries.context_abc(spark, str(tmp_path)).collect())
    near = sorted({j for i in hits for j in range(i - 1, i + 3) if 1 <= j <= n})
    assert got == [(j, j in hits, j != near[0] and j - 1 not in near) for j in near]


@pytest.mark.parametrize("split", [16, 37, 64, 1 << 20])
def test_splits_do_not_show(spark, tmp_path, split):
    p = tmp_path / "q.csv"
    p.write_bytes(b"a,b\n" + b"".join(b'"line\n%d ""q""\n\n",x%d\n' % (i, i) if i % 3 else b"plain%d,y\n" % i for i in range(60)) + b"last,row")
    whole = open_table(spark, str(p)).df.orderBy("record").select("record", "line", "fields").collect()
    t = open_table(spark, str(p), split_bytes=split)
    assert t.df.orderBy("record").select("record", "line", "fields").collect() == whole and len(whole) == 61
    assert sum(s.records for s in t.splits) == 62
    assert t.df.where("record between 20 and 22").count() == 3


def test_faults_surface_through_spark(spark, tmp_path):
    p = tmp_path / "bad.csv"
    p.write_bytes(b"a,b\n1,2\n3\n")
    with pytest.raises(Exception, match=r"record 2 \(line 3\)"):
        out(spark, input=str(p))
    assert out(spark, input=str(p), count=True) == "2\n"


def test_edits_keep_input_numbers_and_untouched_bytes(spark, tmp_path):
    p = tmp_path / "e.csv"
    p.write_bytes(b'a,b\n"1",x\n2,y\n3,z\n4,w')
    out(spark, input=str(p), in_place=True, backup=True, insert=[(2, "i,j")], append=["l,m"], delete=[(3, 3)], update=[(4, "b", "n,n")])
    assert p.read_bytes() == b'a,b\n"1",x\ni,j\n2,y\n4,"n,n"\nl,m\n'
    assert (tmp_path / "e.csv.bak").exists()
    with pytest.raises(EngineError, match="exists"):
        out(spark, input=str(p), in_place=True, backup=True, append=["x,y"])


def test_edit_refusals(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_bytes(b"k,v\na,x\nb,x\n")
    t = open_table(spark, str(p))
    cases = [
        (E.Edits(update_where=[(b"x", b"y")]), "1:2, 2:2"),
        (E.Edits(update_where=[(b"no", b"y")]), "exactly"),
        (E.Edits(update=[(9, 1, b"")]), "no record 9"),
        (E.Edits(update=[(1, 1, b""), (1, "k", b"")]), "twice"),
        (E.Edits(update=[(1, 1, b"")], delete=[(1, 1)]), "deleted"),
        (E.Edits(drop=["k", "v"]), "all columns"),
        (E.Edits(insert=[(1, b"one")]), "fields"),
    ]
    for edits, says in cases:
        with pytest.raises(EngineError, match=says):
            E.edited(t, edits)
    assert E.dry_run_lines(E.changes(t, E.Edits(update=[(2, "v", b"z")]))) == ['update 2:v: "x" -> "z"']
    shaped = E.edited(t, E.Edits(add=[(2, b"n", b"0")]))
    assert [[bytes(v) for v in r["fields"]] for r in sinks.in_order(shaped.df).collect()] == [[b"a", b"0", b"x"], [b"b", b"0", b"x"]]


def test_many_edits_equal_few(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_bytes(b"a,b\n" + b"".join(b"%d,x\n" % i for i in range(1, 401)))
    t = open_table(spark, str(p))
    done = E.edited(t, E.Edits(update=[(i, 2, b"n%d" % i) for i in range(1, 301)]))
    got = [bytes(r["fields"][1]) for r in sinks.in_order(done.df).collect()]
    assert got == [b"n%d" % i if i <= 300 else b"x" for i in range(1, 401)]


def test_rfc8439_vectors():
    key, nonce = bytes(range(0x80, 0xA0)), bytes.fromhex("070000004041424344454647")
    text = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    aad = bytes.fromhex("50515253c0c1c2c3c4c5c6c7")
    sealed = crypto.seal(key, nonce, text, aad)
    assert sealed[-16:].hex() == "1ae10b594f09e26a7e902ecbd0600691"
    assert crypto.unseal(key, nonce, sealed, aad) == text
    assert crypto.unseal(key, nonce, sealed[:-1] + b"\0", aad) is None


def test_protection(spark, pkgs, tmp_path):
    secret = b"0123456789abcdef!"
    t = open_table(spark, pkgs)
    h = protect.hashed(t, "license")
    assert h.header.rows[0][2] == b"license:hash" and h.header.rows[1][2] == "授權:hash".encode()
    assert bytes(h.df.orderBy("record").first()["fields"][2]).decode() == hashlib.sha256(b"MIT").hexdigest()
    key = crypto.hmac_key(secret)
    keyed = protect.hashed(t, "license", secret)
    assert bytes(keyed.df.orderBy("record").first()["fields"][2]).decode() == hmac.new(key, b"MIT", "sha256").hexdigest()
    sealed = str(tmp_path / f"sealed.{TWO_HEADER}")
    sinks.write_table(protect.encrypted(t, "license,pkg", secret), sealed)
    again = open_table(spark, sealed)
    assert sorted(select.protected_columns(again)) == ["license", "pkg"]
    opened = protect.decrypted(again, "all", secret)
    assert select.matches(opened, "MIT").count() == 1 and opened.header == t.header
    with pytest.raises(EngineError, match="another key"):
        protect.decrypted(again, "license", b"another secret of some length")
    with pytest.raises(EngineError, match="protected"):
        protect.hashed(again, "license")
    with pytest.raises(EngineError, match="protected"):
        E.edited(again, E.Edits(update=[(1, "license", b"x")]))
    for bad in (b"short", b"a" * 20):
        with pytest.raises(EngineError):
            crypto.check_secret(bad)


@pytest.mark.parametrize("value", [b"a|b\\c", b"x\ny", b"lit<br>eral", b" pad ", b"---", b":-", b"\x08\x7f\t\r\n", "套件".encode(), b"", b" "])
def test_markdown_cells_round_trip(value):
    assert markdown_unescape(markdown_cell(value)) == value


def test_markdown_tables(spark, tmp_path):
    doc = b"# t\n\n| a | b |\n|---|---|\n|  1 | x\\|y |\n| 2 | z |\n\ntext\n\n| c |\n|---|\n| 9 |\n"
    header, rows, _, _, _ = markdown.read_markdown(doc, 1)
    assert header.names() == ["a", "b"] and rows == [[b"1", b"x|y"], [b"2", b"z"]]
    with pytest.raises(EngineError):
        markdown.read_markdown(doc)
    rows[1][1] = b"w"
    assert markdown.replace_table(doc, 1, header, rows) == doc.replace(b"| 2 | z |", b"|2|w|")
    p = tmp_path / "d.md"
    p.write_bytes(doc)
    list(run(spark, Request(input=str(p), output=str(p) + ".md", markdown=True, titles=True, md_table=1, update=[(2, "b", "w")])))
    assert (tmp_path / "d.md.md").read_bytes() == doc.replace(b"| 2 | z |", b"|2|w|")
    two = markdown.read_markdown("| a<br>甲 |\n|---|\n| 1 |\n".encode())
    assert two[0].rows == ((b"a",), ("甲".encode(),))
    with pytest.raises(EngineError):
        markdown.read_markdown(b"| a<br>x | b |\n|---|---|\n")


def test_text_functions():
    assert report_escape(b"a\tb\n\\\x1b") == "a\\tb\\n\\\\\\x1B"
    assert report_escape(b"x" * 205) == "x" * 200 + "…[+5 more chars]"
    assert report_escape(b"X\xffY") == "<non-UTF-8: 58 ff 59>"
    assert [display_width(x) for x in ("abc", "套件", "é", "❤️", "1️⃣")] == [3, 4, 1, 2, 2]


def test_index(spark, tmp_path):
    p = tmp_path / "i.csv"
    p.write_bytes(b"a,b\n" + b"".join(b'%d,"x\ny"\n' % i for i in range(200)))
    splits = index.build(spark, str(p), split_bytes=256)
    assert index.load(str(p)) == splits and len(splits) > 4
    index.verify(spark, str(p))
    assert index.record_count(spark, str(p)) == 200
    with_index = index.open_indexed(spark, str(p)).df.where("record between 100 and 103").collect()
    assert with_index == index.open_indexed(spark, str(p), use_index=False).df.where("record between 100 and 103").collect()
    with open(p, "ab") as f:
        f.write(b"1,2\n")
    assert index.load(str(p)) is None
    with pytest.raises(EngineError):
        index.verify(spark, str(p))
    os.unlink(index.index_path(str(p)))


def test_append_and_create(tmp_path):
    p = tmp_path / "n.csv"
    sinks.create(str(p), b"a,b")
    with pytest.raises(EngineError):
        sinks.create(str(p), b"a,b")
    sinks.append_rows(str(p), [b"1,2", b'"x,y",z'])
    assert p.read_bytes() == b'a,b\n1,2\n"x,y",z\n'
    with pytest.raises(EngineError):
        sinks.append_rows(str(p), [b"1"])
    for bad in (b"a,a", b"a,", b"a:b"):
        with pytest.raises(EngineError):
            sinks.create(str(tmp_path / "x.csv"), bad)


def test_addresses(spark, pkgs):
    t = open_table(spark, pkgs)
    assert Address.parse("1:license@L3 [C3]").checked(t) == (1, 2)
    for bad in ("1:license@L4", "1:license [B3]"):
        with pytest.raises(EngineError):
            Address.parse(bad).checked(t)
    for bad in ("C3", "0:1", "1"):
        with pytest.raises(EngineError):
            Address.parse(bad)
    assert [parse_range(x) for x in ("3", "3,", ",4", "2,5")] == [(3, 3), (3, None), (None, 4), (2, 5)]


REFUSED = [
    {"create": True}, {"count": True, "json": True}, {"input": "a.csv", "stdin": True}, {"output": "a", "stdout": True}, {"backup": True}, {"filter": True}, {"normalize": True},
    {"after": 1}, {"head": 1, "tail": 1}, {"mid": (1, 2), "head": 1}, {"mid": (3, 2)}, {"markdown": True, "json": True, "titles": True}, {"markdown": True}, {"append": ["x"]},
    {"append": ["x"], "stdout": True, "head": 1}, {"dry_run": True}, {"rownum": True, "json": True}, {"english": True, "chinese": True}, {"hash": "a", "decrypt": "b", "keyfile": "k"},
    {"contains": "x", "search_column": "a", "search_record": 1}, {"contains": "x", "search_record": 5, "head": 3}, {"contains": ""}, {"pretty": True}, {"stdin": True, "input": None},
    {"get": (0, "a")}, {"get": (1, "a"), "json": True}, {"in_place": True}, {"a1": True}, {"md_table": 1}, {"headers": 2}, {"headers": 7}, {"build_index": True, "verify_index": True},
    {"output": "x.csv"}, {"drop_column": ["a"], "add_column": [(1, "b", "")], "stdout": True}, {"truncate_partial": True, "append": ["x"], "stdout": True}, {"encrypt": "a"},
]


@pytest.mark.parametrize("kw", REFUSED)
def test_refusal_matrix(kw):
    with pytest.raises(EngineError) as e:
        validate(Request(**({"input": "t.csv"} | kw)))
    assert e.value.code == "usage" and e.value.message_zh


def test_rules_and_redaction():
    assert len({m for _, m, _ in RULES}) == len(RULES) >= 60
    assert "secret" not in repr(Request(input="t.csv", update=[(1, "a", "secret")], contains="secret"))
    assert validate(Request(input="t.csv", contains="x", filter=True))


def test_streaming_search(spark, tmp_path):
    from cellforge.streaming.search import arriving_lines, matching

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes(b"one needle\r\ntwo\n")
    q = matching(arriving_lines(spark, str(tmp_path / "in")), "needle").writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert [r["value"] for r in spark.table("found").collect()] == ["one needle"]


def test_range_reaches_the_source(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_bytes(b"a\n" + b"".join(b"%d\n" % i for i in range(1000)))
    t = open_table(spark, str(p), split_bytes=512)
    df = t.narrowed(991).df
    assert df.count() == 10 and df.rdd.getNumPartitions() < t.df.rdd.getNumPartitions()


def test_two_ranges_of_one_table_in_one_query(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_bytes(b"a\n" + b"".join(b"%d\n" % i for i in range(1000)))
    t = open_table(spark, str(p), split_bytes=512)
    rows = t.df.where(F.col("record") <= 5).union(t.df.where(F.col("record") > 995)).union(t.narrowed(500, 501).df)
    assert sorted(r["record"] for r in rows.collect()) == [1, 2, 3, 4, 5, 500, 501, 996, 997, 998, 999, 1000]
