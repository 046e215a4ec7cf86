"""Large drawings framed in ranges equal drawings framed whole, wherever they are cut."""

import pytest
from drawing import STYLE, asse, child, drawing, head, rec, section, tex
from pyspark.sql import functions as F

import sparkdraw
from sparkdraw.sources import ranges
from sparkdraw.sources import scan as S
from sparkdraw.sources.limits import Limits

TABLES = ("sections", "records", "lines", "notes", "_drawings")


def content():
    """Mixed line ends, marks before a section, unframed rests, sections read by position, records after the end."""
    body = drawing(section(1, "ENCODING: utf-8\n"), head(), section(6, "Top\n"), section(61, rec("P", 1, 0, 0), rec("P", 2, 3, 4), rec("P", "+x", 1, 1), rec("P", 1, 9, 9)), section(62, rec(*tex(9, "é", "bad")), rec("LIN", 4, *STYLE, 1, 2)), section(6, "Leaf\n"), section(71, rec("LED", 7, *STYLE, 2, 3.5, 1, 0, 0, 0)))
    assert body.endswith(b"##~~\n")
    odd = body[:-5].replace(b"bad", b"b\xffd").replace(b"#~61\n", b"#~61\r\n").replace(b"#~71\n", b"loose\r#~71\r\n")
    return b"\xef\xbb\xbf\r\n" + odd + b"rest\r##~~\r\nmore\n|~\n#~9\n\r\nlast"


def told(corpus, *names):
    def plain(v):
        return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else repr(v)

    out = {}
    for name in names:
        df = getattr(corpus, name)
        df = df.drop("drawing_id", "container_size")
        out[name] = sorted(map(plain, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())), key=repr)
    return out


def one(spark, data, **options):
    return sparkdraw.read(spark, spark.createDataFrame([("d", bytearray(data))], "drawing_id string, content binary"), **options)


def cut(spark, data, places, **options):
    edges = [0, *places, len(data)]
    rows = [("d", i, bytearray(data[a:b])) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return sparkdraw.read(spark, spark.createDataFrame(rows, "drawing_id string, part long, content binary").repartition(3), **options)


@pytest.mark.parametrize("size", [1, 200])
def test_ranges_equal_the_whole(spark, size):
    data = content()
    want, got = told(one(spark, data), *TABLES), told(one(spark, data, range_size=size), *TABLES)
    for name in TABLES:
        assert got[name] == want[name], name


@pytest.mark.parametrize("places", ["every", "carriage returns"])
def test_pieces_cut_anywhere(spark, places):
    data = content()
    at = {"every": range(1, len(data)), "carriage returns": [i + 1 for i, b in enumerate(data[:-1]) if b == 13]}[places]
    want, got = told(one(spark, data), *TABLES), told(cut(spark, data, at), *TABLES)
    for name in TABLES:
        assert got[name] == want[name], name


def rebuilt(data, edges):
    """Framing by the kernel alone, range by range, each with what plain counting says comes before it."""
    out, carry = [], S.Carry()
    for i, (a, b) in enumerate(edges):
        frame = S.Frame(data[a:b], Limits(), carry, i == len(edges) - 1)
        out += frame.records
        started = [p for p in frame.sections if p["at"] is not None]
        parts = carry.parts + sum(p["number"] == 6 for p in started)
        ended = carry.ended or frame.terminator is not None
        last = frame.sections[-1] if frame.sections else None
        open_ = None if ended else last["number"] if last and last["row"] is None else carry.open if not started and carry.open is not None else None
        carry = S.Carry(carry.offset + b - a, carry.line + len(frame.starts), carry.sections + len(started), carry.records + len(frame.records), frame.entities, parts, open_, last["part_index"] if last and open_ is not None else None, ended)
    return out


def test_kernel_at_every_size():
    """Every way in which ``cuts`` can cut a drawing gives the same records."""
    data = content()
    want = S.Frame(data, Limits()).records
    for size in range(1, len(data)):
        edges = list(S.cuts(data, size))
        assert b"".join(data[a:b] for a, b in edges) == data
        assert rebuilt(data, edges) == want, size


def test_ends_that_are_certain():
    assert [ranges.last_line_end(x) for x in (b"", b"a", b"a\n", b"a\r", b"a\rb", b"a\r\n", b"\n\r")] == [0, 0, 2, 0, 2, 3, 1]
    assert [ranges.last_mark_end(x) for x in (b"P\n1\n", b"P\n|~\nx\n", b" #~1 \r\nx|~\n", b"#~99999999999\n")] == [0, 5, 7, 14]


def test_errors_and_limits(spark):
    """A large drawing over a limit, or that is none, is one error, and others are read."""
    good = content()
    rows = [("good", good), ("bad", b"no drawing\n" * 30), ("long", drawing(section(61, rec("P", 1, "0" * 300, 0))))]
    rows = [(n, bytearray(x)) for n, x in rows]
    df = spark.createDataFrame(rows, "drawing_id string, content binary")
    for size in (20, 1 << 20):
        corpus = sparkdraw.read(spark, df, Limits(max_line_length=200), range_size=size)
        assert sorted((r.drawing_id, r["class"]) for r in corpus.errors.collect()) == [("bad", "InvalidDrawing"), ("long", "LimitExceeded")]
        assert {r.drawing_id for r in corpus.records.select("drawing_id").distinct().collect()} == {"good"}
    with pytest.raises(Exception, match="LimitExceeded|InvalidDrawing"):
        sparkdraw.read(spark, df, Limits(max_line_length=200), mode="FAILFAST", range_size=20).records.count()


def test_semantics_of_ranges(spark):
    """Entities, first ids, parts and diagnostics do not depend on the ranges."""
    data = drawing(section(5, asse(10, "Top", child(20, 1, 2)), asse(20, "Leaf")), section(6, "Top\n"), section(61, rec("P", 1, 0, 0), rec("P", 2, 3, 4), rec("P", 2, 5, 6)), section(6, "Leaf\n"), section(61, rec("P", 3, 1, 1)), section(62, rec("LIN", 4, *STYLE, 1, 2)))
    whole, parts = one(spark, data), one(spark, data, range_size=30)
    assert told(whole, "entities", "diagnostics", "parts", "instances", "lines_geo") == told(parts, "entities", "diagnostics", "parts", "instances", "lines_geo")
    assert parts.scan.where("row = 'record'").count() == 9


def test_a_large_drawing_is_dealt_out(spark):
    """Many ranges, in many tasks, give the counts of the whole."""
    point = "".join(f"P\n{i}\n{i}\n0\n|~\n" for i in range(1, 20_001))
    data = f"#~6\nTop\n#~61\n{point}##~~\n".encode()
    corpus = one(spark, data, range_size=10_000)
    _, ready, _ = corpus._framed
    assert ready.count() > 25
    found = corpus.records.agg(F.count("*"), F.max("record_index"), F.max("entity_index"), F.max("offset"), F.countDistinct("start_line")).first()
    # The name of the part is a record without a terminator.
    assert tuple(found)[:3] == (20_001, 20_000, 19_999) and found[4] == 20_001
    assert corpus.lines.count() == 20_000 * 5 + 4
    assert corpus.sections.where("number = 61").first().record_count == 20_000
