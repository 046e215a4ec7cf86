"""Framing, decoding, resolution and traversal on drawings written here."""

import gzip
import math
import zlib

import numpy as np
import pytest
from drawing import OLD_STYLE, STYLE, asse, child, drawing, head, rec, section, tex
from plain_encoding import detect, version_is_utf8
from pyspark.sql import functions as F

import sparkdraw
from sparkdraw.functions import geometry as G
from sparkdraw.functions import text as codecs
from sparkdraw.functions.strict import Fields
from sparkdraw.operators import query


def read(spark, *contents, **options):
    rows = [(f"d{i}", bytearray(c)) for i, c in enumerate(contents)]
    return sparkdraw.read(spark, spark.createDataFrame(rows, "drawing_id string, content binary"), **options)


def codes(corpus):
    return sorted(r.code for r in corpus.diagnostics.select("code").collect())


POINTS = section(61, rec("P", 1, 0, 0), rec("P", 2, 3, 4), rec("P", 3, "-3", "4.0e0"))


def test_lines_rebuild_the_bytes(spark):
    data = b"\xef\xbb\xbf\r\n#~1\r\nfoo\n\nbar\r#~61\nP\n1\n0\n0\n |~ \n##~~\ntrailing"
    corpus = read(spark, data)
    rows = corpus.lines.orderBy("number").collect()
    ends = {"lf": b"\n", "crlf": b"\r\n", "cr": b"\r", "none": b""}
    assert b"".join(bytes(r.content) + ends[r.ending] for r in rows) == data
    assert [r.kind for r in rows] == ["blank", "section_marker", "data", "blank", "data", "section_marker", "data", "data", "data", "data", "entity_terminator", "file_terminator", "data"]
    one = corpus.drawings.first()
    assert (one.newlines.lf, one.newlines.crlf, one.newlines.cr, one.newlines.unterminated) == (9, 2, 1, 1)
    assert one.trailing_bytes == 8 and one.termination == "file_marker" and one.format.utf8_bom
    cut = corpus.slices(corpus.records.where("record_type = 'P'").select("drawing_id", "offset", "length")).first()
    assert bytes(cut.bytes) == b"P\n1\n0\n0\n |~ \n"
    assert {"MI_MIXED_LINE_ENDINGS", "MI_TRAILING_DATA"} <= set(codes(corpus))


def test_framing_traps(spark):
    data = drawing("|~\n", section(61, "|~\n", rec("P", 1, 0, 0), "left over\n"), section(99, "loose text\n"), section(4294967296, rec("P", 2, 1, 1)), end="")
    corpus = read(spark, "#~1\n".encode() + data)
    rows = corpus.records.orderBy("record_index").collect()
    # An empty payload is a record, loose text has no type, and a number beyond 32 bits is no section mark.
    assert [(r.record_type, r.termination) for r in rows][1:4] == [(None, "entity_marker"), ("P", "entity_marker"), (None, "section_boundary")]
    assert {"MI_UNTERMINATED_RECORD", "MI_MISSING_FILE_TERMINATOR"} <= set(codes(corpus))
    early = read(spark, drawing(" \n", section(6, "Top\n")))
    assert early.drawings.first().preamble_span.length == 2


def test_strict_numbers(spark):
    rows = [("1.0d",), ("1f",), ("0x1p3",), ("\x0b1",), (" 1.5e2\t",), ("NaN",), ("1e999",), ("+7",), ("-7",), (".5",), ("",), ("9223372036854775808",), ("true",)]
    f = Fields("a")
    got = spark.createDataFrame(rows, "x string").select("x", F.array("x").alias("a")).select("x", f.f(0).alias("f"), f.u(0).alias("u"), f.i(0).alias("i"), f.b(0).alias("b")).collect()
    by = {r.x: r for r in got}
    assert [by[x].f for (x,) in rows[:4]] == [None] * 4 and by[" 1.5e2\t"].f == 150 and by["NaN"].f is None and by["1e999"].f is None
    assert by["+7"].u == 7 and by["-7"].u is None and by["-7"].i == -7 and by[".5"].f == 0.5 and by[""].f is None and by["9223372036854775808"].u is None
    assert by["+7"].b is None


def test_geometry_and_references(spark):
    data = drawing(
        head(), section(41, rec("ASSP", 7, 1, "LAYER: walls")), section(6, "Top\n"), POINTS,
        section(62, rec("LIN", 10, *OLD_STYLE, 1, 2), rec("LIN", 11, *STYLE, 1, 99), rec("LIN", 12, *STYLE, 7, 2), rec("ARC", 13, *STYLE, 1, 2, 3, 0), rec("FIL", 14, *STYLE, 1, 2, 3, 5), rec("CIR", 15, *STYLE, 1, 2), rec("LIN", 16, 1, 0, 0.5, 1, 7, 1, 2)),
    )
    corpus = read(spark, data)
    lines = {r.entity_id: r for r in corpus.lines_geo.collect()}
    assert (lines[10].start.x, lines[10].end.y) == (0.0, 4.0) and lines[11].end is None and lines[12].start is None and 16 not in lines
    assert lines[10].graphic.layout == "legacy" and lines[10].graphic.property_ids == [7]
    arcs = {r.entity_id: r for r in corpus.arcs.collect()}
    assert arcs[13].radius == 5 and arcs[13].ccw is True and arcs[14].ccw is None
    assert arcs[13].start_angle == pytest.approx(math.atan2(4, 3)) and arcs[13].end_angle == pytest.approx(math.atan2(4, -3))
    assert corpus.circles.first().radius == 5
    assert codes(corpus) == sorted(["MI_DANGLING_POINT_REFERENCE", "MI_INVALID_ENTITY_RECORD", "MI_REFERENCE_TYPE_MISMATCH"])
    assert corpus.layers.where("entity_index = 4").first().layer == "walls"
    ids = lambda q: sorted(r.entity_id for r in corpus.query(q).collect())
    assert ids("arc") == [13] and ids("Fillet, circle") == [14, 15] and ids("*") == [10, 11, 12, 13, 14, 15]
    shapes = {r.entity_id: r for r in corpus.polylines(4).collect()}
    assert len(shapes[13].vertices) == 5 and shapes[14].skipped == "unknown orientation" and shapes[11].skipped == "unresolved geometry"
    assert (shapes[13].vertices[0].x, shapes[13].vertices[-1].x) == (3.0, -3.0)
    assert {(r.reason, r["count"]) for r in corpus.skipped(4).collect()} == {("unknown orientation", 1), ("unresolved geometry", 2)}


def test_query_names():
    assert query.record_types("DIMENSION, led", query.ANNOTATIONS) == ["DANG", "DCHMF", "DDIA", "DRAD", "DSGL", "LED"]
    for wrong in ("DIMENSION", "line, nonsense"):
        with pytest.raises(ValueError):
            query.record_types(wrong, query.GRAPHICS)
    assert query.record_types("  ", query.GRAPHICS) is None


def test_bad_records_stay(spark):
    data = drawing(head(), section(41, rec("PSTAT", 1, 0, 2), rec("DTA", 2, 2, "a", "b"), rec("HAPP", 3, 1, 0, 0, 0, 0)), section(61, rec("P", 4, "NaN", 0), rec("P", 5), rec("P", "x", 0, 0), rec("P", 4, 1, 1)), section(71, rec("MYSTERY", 8, "x")))
    corpus = read(spark, data)
    assert [r.kind for r in corpus.entities.orderBy("entity_index").collect()] == ["unsupported"] * 5 + ["point", "unsupported"]
    assert codes(corpus) == sorted(["MI_INVALID_ENTITY_RECORD"] * 5 + ["MI_INVALID_ENTITY_ID", "MI_DUPLICATE_ENTITY_ID", "MI_UNSUPPORTED_ENTITY", "MI_ENTITY_SECTION_OUTSIDE_PART", "MI_ENTITY_SECTION_OUTSIDE_PART"])
    # The first entity with an id counts, even if it cannot be decoded.
    assert corpus.located.count() == 0


def test_annotations(spark):
    dsgl = [0] * 70
    dsgl[7], dsgl[8], dsgl[16], dsgl[18], dsgl[20], dsgl[21], dsgl[40], dsgl[50] = 1, 2, 6, 6, 12.5, "12.5 mm", 20, 20
    data = drawing(
        head(), section(42, rec("DTV", 20, 1, 0.1, -0.1, 0, "+0.1", "-0.1", 6, 5), rec("DTF", 6, 2, 1, -2), rec("HAPP", 9, 1, 0, 2.5, 0.7, 1, 0), rec("DTA", 5, 4, "f", "g", "h", 2.5)), section(6, "Top\n"),
        section(71, rec("LED", 30, *STYLE, 2, 3.5, 2, 0, 0, 0, 1, 1, 0), rec("COC", 31, *STYLE, 1, 0, 1, 40), rec("COC", 32, *STYLE, 1, 0, 1, 40), rec("HAT", 33, *STYLE, 0, 0, 0.5, 2)),
        section(72, rec("PFA", 34, 0, 33, 31, 0), rec("PFA", 35, 1, 9, 33, 31, 1, 32), rec("DSGL", 36, 0, *dsgl), rec("SYML", 37, 31, 40, 77)),
        section(62, rec("LIN", 40, *STYLE, 1, 2)),
    )
    corpus = read(spark, data)
    assert corpus.hatches.first().boundary_loop_ids == [31, 32]  # the last association
    one = corpus.dimensions.first()
    assert one.measurement == 12.5 and one.formatted_text.text == "12.5 mm" and one.tolerance_ids == [20] and one.dimension_style_id == 6
    assert [(p.x, p.y) for p in corpus.leaders.first().points] == [(0.0, 0.0), (1.0, 1.0)]
    assert corpus.tolerances.first().upper_text.text == "+0.1"
    props = {r.entity_id: r for r in corpus.properties.collect()}
    assert props[6].integer_definition == [1, -2] and props[9].hatch_pattern[0].distance == 2.5 and props[5].dimension_text_attribute.font_name.text == "f"
    found = {(r.role, r.target): r.status for r in corpus.references.collect()}
    assert found["symbol component", 31] == "mismatch" and found["symbol component", 40] == "ok" and found["symbol component", 77] == "dangling"
    assert [r.mi_type for r in corpus.query_annotations("*").orderBy("entity_index").collect()] == ["DTV", "LED", "HAT", "DSGL", "SYML"]
    stats = {(r.metric, r["item"], r.value): r["count"] for r in corpus.audit().collect()}
    assert stats["typed", "COC", ""] == 2 and stats["hatch_boundary_counts", "HAT", "2"] == 1 and stats["tolerance_counts", "DSGL", "1"] == 1


def test_texts(spark):
    old = tex(50, "one", "two", start=OLD_STYLE, modern=False)
    new = tex(51, "ünï", modern=True)
    bent = tex(52, "x", matrix=(1, 0, 0, 0, 1, 0, 0, 0, 2))
    corpus = read(spark, drawing(head("3.20"), section(62, rec(*old), rec(*new), rec(*bent))))
    rows = {r.entity_id: r for r in corpus.texts.collect()}
    assert set(rows) == {50, 51} and rows[50].text == "one\ntwo" and rows[50].content.text == "one" and rows[51].text == "ünï"
    assert rows[50].alternate_font_name is None and rows[51].alternate_font_name.text == "alt" and rows[50].width_factor == 0.5 and (rows[50].horizontal, rows[50].vertical) == ("left", "lower")
    assert corpus.drawings.first().encoding.source == "mi_version"


def test_text_errors_name_the_byte(spark):
    data = drawing(section(1, "ENCODING: sjis\n"), head(), section(62, rec(*tex(50, "ab"))))
    data = data.replace(b"\nab\n", b"\na\x82\xa0\xfdb\n")
    corpus = read(spark, data)
    bad = corpus.diagnostics.where("code = 'MI_TEXT_DECODE_ERROR'").collect()
    assert len(bad) == 1 and data[bad[0].span.offset : bad[0].span.offset + bad[0].span.length] == b"\xfd"
    assert corpus.texts.first().text is None and bytes(corpus.texts.first().content.raw_bytes) == b"a\x82\xa0\xfdb"


def test_encodings():
    assert codecs.encoding_of("Shift-JIS") == "shift_jis" and codecs.encoding_of("UTF_8") == "utf-8" and codecs.encoding_of("latin1") is None
    assert not version_is_utf8("3.4") and version_is_utf8("3.20") and version_is_utf8("4") and not version_is_utf8("x.30")
    assert codecs.decode(b"\x81\x60", "shift_jis") == "～" and codecs.decode(b"\x80", "shift_jis") == "\x80"
    for raw, encoding, at in ((b"a\xa0", "shift_jis", 1), (b"\xfd", "shift_jis", 0), (b"ok\xff", "utf-8", 2), (b"\xff", "hp-roman8", 0)):
        with pytest.raises(codecs.BadBytes) as bad:
            codecs.decode(raw, encoding)
        assert bad.value.offset == at
    assert codecs.decode(b"\xe8\xff"[:1], "hp-roman8") != ""
    assert detect(None, False, None, None, [b"abc"])[:2] == (None, "ascii_only")
    assert detect(None, False, None, None, ["é".encode()])[:2] == ("utf-8", "heuristic")
    assert detect(None, False, None, None, [b"\x82\xa0"])[:2] == ("shift_jis", "heuristic")
    assert detect(None, False, None, None, [b"\xff"])[1] == "undetermined"
    assert detect(None, False, "3.20", "sjis", []) == ("utf-8", "mi_version", "MI_ENCODING_CONFLICT")
    assert detect("hp-roman8", True, "3.20", None, [])[0] == "hp-roman8"


TREE = [
    head(), section(42, rec("ASSP", 5, 1, "DOCU_SHEET")),
    section(5, asse(100, "Top", child(101, 10, 0, (5,)), child(102, 0, 0)), asse(101, "Sheet", child(102, 1, 2), child(102, 3, 4)), asse(102, "Leaf")),
    section(6, "Top\n"), section(6, "Sheet\n"), section(6, "Leaf\n"), POINTS, section(62, rec("LIN", 10, *STYLE, 1, 2)),
]


def test_tree(spark):
    corpus = read(spark, drawing(*TREE))
    rows = corpus.occurrences().orderBy("order_key").collect()
    assert [(r.part_index, r.world.tx, r.world.ty, r.is_sheet) for r in rows] == [(0, 0, 0, False), (1, 10, 0, True), (2, 11, 2, False), (2, 13, 4, False), (2, 0, 0, False)]
    assert [(s.assembly_id, s.instance_index) for s in rows[3].path] == [(100, 0), (101, 1)]
    assert sorted((r.start.x, r.end.y) for r in corpus.placed_lines().collect()) == [(0.0, 4.0), (11.0, 6.0), (13.0, 8.0)]
    parts = {r.name: r for r in corpus.parts.collect()}
    assert parts["Sheet"].child_part_indices == [2, 2] and sorted(parts["Leaf"].parent_part_indices) == [0, 1] and parts["Leaf"].graphic_ids == [10]
    one = corpus.drawings.first()
    assert one.top_part_index == 0 and one.root_part_indices == [0] and one.sheet_part_indices == [1]
    assert corpus.placed_graphics().count() == 3 and corpus.sheet_instances().count() == 1 and corpus.modelspace().count() == 0


def test_tree_faults(spark):
    cycle = [head(), section(5, asse(1, "Top", child(2, 0, 0)), asse(2, "B", child(1, 0, 0), child(9, 0, 0), child(2, 0, 0, matrix=(1, 0, 0, 0, 1, 0, 0, 1, 1)))), section(6, "B\n"), section(6, "Top\n")]
    corpus = read(spark, drawing(*cycle))
    assert corpus.occurrences(strict=False).count() == 2
    with pytest.raises(Exception, match="assembly contains itself|no bound part|not affine"):
        corpus.occurrences(strict=True).collect()
    assert "MI_DANGLING_ASSEMBLY_REFERENCE" in codes(corpus)
    # A fallback by place can take the part that a later assembly names.
    greedy = read(spark, drawing(head(), section(5, asse(1, "X"), asse(2, "A"), asse(3, "C")), section(6, "A\n"), section(6, "B\n")))
    assert [(r.entity_index, r.part_index, r.by_name) for r in greedy.bound.orderBy("entity_index").collect()] == [(0, 0, False), (1, 1, False), (2, None, False)]
    assert {"MI_UNBOUND_ASSEMBLY", "MI_ASSEMBLY_PART_NAME_MISMATCH"} <= set(codes(greedy))
    deep = [asse(i, f"p{i}", child(i + 1, 1, 0)) for i in range(1, 121)] + [asse(121, "p121")]
    chain = read(spark, drawing(head(), section(5, *deep), *[section(6, f"p{i}\n") for i in range(1, 122)]))
    assert chain.occurrences().agg(F.max("world.tx")).first()[0] == 120


def test_splines(spark):
    knots = [0, 0, 0, 1, 2, 2, 2]
    controls = np.array([[0, 0], [1, 2], [3, 2], [4, 0]], float)
    at = np.array([0, 0.5, 1, 1.7, 2])
    got = G.spline_points(2, np.array(knots, float), controls, at)

    def basis(i, k, t):
        if k == 0:
            return float(knots[i] <= t < knots[i + 1] or (t == knots[-1] and knots[i] < t <= knots[i + 1]))
        a = (t - knots[i]) / (knots[i + k] - knots[i]) if knots[i + k] > knots[i] else 0
        b = (knots[i + k + 1] - t) / (knots[i + k + 1] - knots[i + 1]) if knots[i + k + 1] > knots[i + 1] else 0
        return a * basis(i, k - 1, t) + b * basis(i + 1, k - 1, t)

    assert np.allclose(got, [sum(basis(i, 2, t) * controls[i] for i in range(4)) for t in at])
    assert G.spline_points(2, np.array(knots, float), controls, np.array([2.1])) is None
    half = G.spline_points(1, np.array([0.0, 0, 1, 1]), np.array([[0.0, 0], [1, 0]]), np.array([0.5]), np.array([1.0, 3.0]))
    assert np.allclose(half, [[0.75, 0]])
    spline = rec("BSPL", 20, *STYLE, 3, 0, 0, 2, 1, 3, 4, 1, 2, 3, 1, 7, *knots, 1, 2, 0.5, 0, 0, 0, 0, 0)
    corpus = read(spark, drawing(head(), POINTS, section(62, spline, rec("BSPL", 21, *STYLE, 3, 0, 0, 2, 1, 3, 4, 1, 2, 3, 99, 7, *knots, 0))))
    rows = {r.entity_id: r for r in corpus.bsplines.collect()}
    assert rows[20].degree == 2 and rows[20].domain.end == 2 and len(rows[20].control_points) == 4 and rows[20].samples[0].point_id == 2 and rows[21].samples == []
    shapes = {r.entity_id: r.vertices for r in corpus.polylines(4).collect()}
    assert len(shapes[20]) == 5 and shapes[21] is None


def test_envelopes_and_limits(spark):
    plain = drawing(*TREE)
    packed = gzip.compress(plain)
    broken = packed[:-9] + bytes([packed[-9] ^ 255]) + packed[-8:]
    cases = [plain, packed, packed[:-4], broken, packed + b"x", packed + packed, gzip.compress(b"no drawing"), zlib.compress(b"x"), b"PK\x03\x04", b"\x1f\x9d", b"nothing", b""]
    corpus = read(spark, *cases)
    errors = {r.drawing_id: r["class"] for r in corpus.errors.collect()}
    assert errors == {f"d{i}": ("UnsupportedDrawing" if i in (7, 8, 9) else "InvalidDrawing") for i in range(2, 12)}
    both = corpus.lines_geo.groupBy("entity_id", "start", "end").count().collect()
    assert [r["count"] for r in both] == [2]
    for options, data in (({"max_lines": 3}, plain), ({"max_records": 2}, plain), ({"max_sections": 2}, plain), ({"max_line_length": 3}, plain), ({"max_record_size": 10}, plain), ({"max_decompressed_size": 50}, packed), ({"max_decompressed_size": 50}, plain), ({"max_compression_ratio": 2}, gzip.compress(b"#~1\n" + b"\n" * 5000)), ({"max_file_size": 20}, plain)):
        assert read(spark, data, limits=sparkdraw.Limits(**options)).errors.first()["class"] == "LimitExceeded", options
    for wrong, error in ((0, ValueError), (True, TypeError), (1.5, TypeError)):
        with pytest.raises(error):
            sparkdraw.Limits(max_lines=wrong)
    with pytest.raises(ValueError):
        read(spark, plain, encoding="klingon")
    with pytest.raises(Exception, match="InvalidDrawing"):
        read(spark, b"nothing", mode="FAILFAST").records.count()


def test_truncations_never_crash(spark):
    data = drawing(*TREE)
    cuts = [data[:i] for i in range(0, len(data), 23)]
    flips = [data[:i] + bytes([data[i] ^ 128]) + data[i + 1 :] for i in range(0, len(data), 41)]
    corpus = read(spark, *cuts, *flips)
    assert corpus.drawings.count() == len(cuts) + len(flips)
    assert corpus.diagnostics.count() > 0 and corpus.polylines(4).count() >= 0


def test_header_and_toc(spark):
    short = "#~3\nonly\n"
    corpus = read(spark, drawing(section(2, "LAST: 9\n"), head("9.9"), POINTS), drawing(section(2, "LAST:x\n"), short), drawing(section(6, " \n")))
    rows = {r.drawing_id: r for r in corpus.drawings.collect()}
    box = rows["d0"]["global"].extents
    assert (box.xmin, box.xmax, box.ymin, box.ymax) == (0, 10, -1, 5) and rows["d0"].toc_last_entity == 9 and rows["d0"]["global"].unit == "mm"
    by = {}
    for r in corpus.diagnostics.collect():
        by.setdefault(r.drawing_id, set()).add(r.code)
    assert by["d0"] == {"MI_GLOBAL_LAYOUT_UNVERIFIED", "MI_TOC_LAST_MISMATCH", "MI_ENTITY_SECTION_OUTSIDE_PART"}
    assert by["d1"] == {"MI_GLOBAL_RECORD_TOO_SHORT", "MI_INVALID_TOC_LAST"} and by["d2"] == {"MI_MISSING_GLOBAL_SECTION", "MI_EMPTY_PART_NAME"}


def test_affine(spark):
    values = [2.0, 1.0, 5.0, 0.0, 3.0, -1.0, 0.0, 0.0, 1.0]
    df = spark.createDataFrame([(values,), ([*values[:8], 1.1],), ([0.0] * 8 + [1.0],)], "v array<double>").select("v", G.from_values(F.col("v")).alias("m"))
    rows = df.select("m", G.inverse(F.col("m")).alias("i"), G.mirrored(F.col("m")).alias("r"), G.to_values(F.col("m")).alias("v")).collect()
    assert rows[0].v == values and rows[1].m is None and rows[2].i is None and rows[0].r is False
    back = df.limit(1).select(G.apply(G.inverse(F.col("m")), G.apply(F.col("m"), G.point(F.lit(3.0), F.lit(4.0)))).alias("p")).first().p
    assert back.x == pytest.approx(3) and back.y == pytest.approx(4)


def test_files_views_stream_and_cli(spark, tmp_path, capsys):
    from sparkdraw import cli
    from sparkdraw.streaming.ingest import read_stream

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.mi").write_bytes(drawing(*TREE))
    (folder / "b.bin").write_bytes(gzip.compress(drawing(*TREE)))
    (folder / "c.txt").write_bytes(b"not a drawing")
    corpus = sparkdraw.read(spark, str(folder))
    assert corpus.drawings.count() == 3 and corpus.errors.count() == 1
    corpus.register_views("mi_")
    assert spark.sql("SELECT count(*) FROM mi_lines_geo g JOIN mi_parts p USING (drawing_id, part_index) WHERE p.name = 'Leaf'").first()[0] == 2
    assert cli.main(["inspect", str(folder / "a.mi"), "--json", "--records", "--lines"]) == 0
    assert '"record_types": {"ASSE": 3' in capsys.readouterr().out
    assert cli.main(["inspect", str(folder / "c.txt")]) == 1
    assert cli.main(["audit", str(folder)]) == 0 and "| typed | LIN |  | 2 |" in capsys.readouterr().out
    run = read_stream(spark, str(folder), str(tmp_path / "out"), tables=("records", "diagnostics"))
    assert run.awaitTermination(120) and spark.read.parquet(str(tmp_path / "out/records")).count() == corpus.records.count()
    corpus.close()


def test_tables_of_an_empty_corpus(spark):
    corpus = sparkdraw.read(spark, spark.createDataFrame([], "drawing_id string, content binary"))
    assert corpus.drawings.count() == corpus.diagnostics.count() == corpus.parts.count() == corpus.occurrences().count() == corpus.polylines().count() == 0
