"""Bytes to records and back: every accepted and refused shape."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellforge.model import TWO_HEADER, EngineError, Format, Header, Marker
from cellforge.sources.parser import encode, parse, record_spans

CSV, TWO, LINES = Format.CSV, Format.TWO, Format.LINES


def rows(data, format=CSV, **kw):
    return [r.fields for r in parse(data, format, **kw)[1]]


@pytest.mark.parametrize(
    ("data", "format", "want"),
    [
        (b"a,b\r\n1,2\n3,4\r\n", CSV, [[b"1", b"2"], [b"3", b"4"]]),
        (b'a,b\n"x\r\ny",2\n', CSV, [[b"x\r\ny", b"2"]]),
        (b"\xef\xbb\xbfa,b\n1,2\n", CSV, [[b"1", b"2"]]),
        (b"a,b\n\xff\xfe1,2\n", CSV, [[b"\xff\xfe1", b"2"]]),
        (b'a,b\nx"y,2\n', CSV, [[b'x"y', b"2"]]),
        (b'a,b\n"q""z",""\n', CSV, [[b'q"z', b""]]),
        (b"a,b\n1,2", CSV, [[b"1", b"2"]]),
        (b"a,b\n1\rx,2\n", CSV, [[b"1\rx", b"2"]]),
        (b"a,b\n#c,x\n", CSV, [[b"#c", b"x"]]),
        (b"k,v\nk2,v2\nx,a\\nb\\\\c\n", TWO, [[b"x", b"a\nb\\c"]]),
        (b'a,"b\n\n#x\n', LINES, [[b'a,"b'], [b""], [b"#x"]]),
    ],
)
def test_accepted(data, format, want):
    assert rows(data, format) == want


@pytest.mark.parametrize(
    ("data", "format", "says"),
    [
        (b"a,b\n1,2\n3\n", CSV, "record 2 (line 3)"),
        (b"a,b\n1,2\n\n3,4\n", CSV, "blank line"),
        (b"a,b\n#c\n", CSV, "comment"),
        (b"a,b\r1,2\r", CSV, "carriage return"),
        (b'a,b\n1,"2\n', CSV, "inside a quoted cell"),
        (b'a,b\n"x"y,2\n', CSV, "closing quote"),
        (b"a,b\n1,2\r", CSV, "carriage return"),
        (b"k,v\nk2,v2\nx,y", TWO, "no line feed"),
        (b"k,v\nk2,v2\nx,\\q\n", TWO, "unknown escape"),
        (b'k,v\nk2,v2\n"x\ny",z\n', TWO, "raw line feed"),
        (b"k,v\nk2\n", TWO, "differ in width"),
        (b"\xff\xfea\n", CSV, "UTF-16"),
        (b"\x1f\x8b..", CSV, "gzip"),
        (b"a:x,b\n1,2\n", CSV, "colon"),
        (b"#a\n1\n", CSV, "comment"),
        (b"a\n| --- |\n", CSV, "Markdown"),
        (b"", CSV, "before its 1 header"),
    ],
)
def test_refused(data, format, says):
    with pytest.raises(EngineError, match=says.replace("(", r"\(").replace(")", r"\)")):
        parse(data, format)


def test_truncate_drops_only_a_torn_record():
    assert rows(b'a,b\n1,2\n3,"4', truncate=True) == [[b"1", b"2"]]
    assert rows(b"k,v\nk2,v2\nx,y\nz", TWO, truncate=True) == [[b"x", b"y"]]


def test_line_and_record_numbers():
    _, got = parse(b'a,b\n"p\nq",1\nneedle,2\n', CSV)
    assert [(r.number, r.line, r.offset) for r in got] == [(1, 2, 4), (2, 4, 12)]


cell = st.binary(max_size=12).map(lambda b: b.replace(b"\r", b""))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(cell, min_size=2, max_size=2), max_size=8), st.sampled_from([CSV, TWO]))
def test_round_trip(table, format):
    table = [r if any(b"\n" not in v or True for v in r) else r for r in table]
    head = [[b"a", b"b"]] * format.header_rows
    data = b"".join(encode(r, format) for r in head + table)
    assert rows(data, format) == table


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text('ab",\n', max_size=6).map(str.encode), min_size=2, max_size=2), max_size=8), st.integers(1, 40))
def test_any_cut_chains_to_the_same_record_ends(table, at):
    data = b"".join(encode(r, CSV) for r in table)
    whole = record_spans(data, CSV).ends.tolist()
    cut = data.find(b"\n", at) + 1
    left = record_spans(data[:cut], CSV)
    right = record_spans(data[cut:], CSV, left.inside)
    assert left.ends.tolist() + [cut + e for e in right.ends.tolist()] == whole


def test_formats_and_markers():
    assert [Format.of(p) for p in ("a.CSV", f"b.x.{TWO_HEADER}", "c.csv.txt", "noext", "d.v2/x")] == [CSV, TWO, LINES, LINES, LINES]
    for name in ("n:hash", "n:hmac:0011", "n:enc:0011:AAECAw==", "n"):
        assert str(Marker.parse(name)) == name and Marker.parse(name).base == "n"


def test_columns_are_never_guessed():
    h = Header(((b"a", b"2", b"a", b"x:hash"),), 4)
    assert h.resolve("x") == 3 and h.resolve("4") == 3
    for token, code in (("a", "ambiguous"), ("2", None), ("9", "out-of-range"), ("zz", "not-found")):
        if code:
            with pytest.raises(EngineError) as e:
                h.resolve(token)
            assert e.value.code == code
    assert h.resolve("2") == 1
    assert Header(((b"2", b"b"),), 2).resolve("1") == 0
    with pytest.raises(EngineError):
        Header(((b"2", b"b"),), 2).resolve("2")
