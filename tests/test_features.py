"""Attachments, previews, reports and refusals."""

import gzip
import importlib.util
import json

import pytest
from drawing import STYLE, asse, child, drawing, head, rec, section, tex
from pyspark.sql import functions as F

import sparkdraw


def read(spark, *contents, **options):
    rows = [(str(i), bytearray(x)) for i, x in enumerate(contents)]
    return sparkdraw.read(spark, spark.createDataFrame(rows, "drawing_id string, content binary"), **options)


POINTS = section(61, rec("P", 1, 0, 0), rec("P", 2, 3, 4))
LINE = section(62, rec("LIN", 3, *STYLE, 1, 2), rec(*tex(4, "hello")))


def test_modelspace_needs_a_part(spark):
    bare, whole = drawing(head(), POINTS, LINE), drawing(head(), section(6, "Top\n"), POINTS, LINE)
    assert read(spark, bare, whole).modelspace().select("drawing_id").distinct().collect() == [("1",)]
    found = read(spark, bare, whole, mode="FAILFAST").modelspace()
    with pytest.raises(Exception, match="no part"):
        found.count()
    assert read(spark, whole, mode="FAILFAST").modelspace("line").count() == 1


def test_marks_turn_and_grow_with_their_part(spark):
    """A part placed a quarter turn on and twice as large."""
    top = section(5, asse(10, "Top", child(20, 0, 0, matrix=(0, -2, 100, 2, 0, 0, 0, 0, 1))), asse(20, "A"))
    data = drawing(head(), top, section(6, "Top\n"), section(6, "A\n"), POINTS, LINE)
    flat = {r.entity_id: r for r in read(spark, data).marks().collect()}
    assert (flat[2]["at"].x, flat[2]["at"].y, flat[2].text) == (3, 4, None) and flat[4].text == "hello" and (flat[4]["at"].x, flat[4]["at"].y) == (5, 5)
    placed = {r.entity_id: r for r in read(spark, data).marks(expand=True).collect()}
    assert (placed[2]["at"].x, placed[2]["at"].y) == (92, 6)
    assert placed[4].rotation == pytest.approx(1.5707963) and placed[4].height == pytest.approx(2 * flat[4].height)


def test_nothing_to_draw(spark):
    corpus = read(spark, drawing(head()))
    assert corpus.polylines(4).count() == 0 and corpus.skipped(4).count() == 0
    for wrong in (1, 0, -5):
        with pytest.raises(ValueError, match="segments"):
            corpus.polylines(wrong)
    for wrong in (2.5, True, "8"):
        with pytest.raises(TypeError, match="segments"):
            corpus.polylines(wrong)


@pytest.mark.skipif(importlib.util.find_spec("matplotlib") is None, reason="previews need matplotlib")
def test_preview(spark, tmp_path):
    data = drawing(head(), section(6, "Top\n"), POINTS, LINE, section(62, rec("LIN", 9, *STYLE, 1, 777)))
    with pytest.warns(UserWarning, match="unresolved geometry: 9"):
        read(spark, data).draw(f"{tmp_path}/x.png", "0", points=True)
    assert open(f"{tmp_path}/x.png", "rb").read(4) == b"\x89PNG"


def test_preview_without_matplotlib(spark, tmp_path, monkeypatch):
    from sparkdraw.operators import polylines

    monkeypatch.setattr(importlib.util, "find_spec", lambda name: None)
    with pytest.raises(ImportError, match="matplotlib"):
        polylines.draw(spark.createDataFrame([], polylines.SHAPES), f"{tmp_path}/x.png")
    with pytest.raises(ValueError, match="line_width"):
        polylines.draw(spark.createDataFrame([], polylines.SHAPES), f"{tmp_path}/x.png", line_width=0)


def test_slices_keep_columns_and_open_envelopes(spark):
    data = drawing(head(), POINTS)
    corpus = read(spark, data, gzip.compress(data), b"no drawing")
    spans = corpus.records.where("record_type = 'P'").select("drawing_id", "offset", "length", F.col("entity_id").alias("mine"))
    got = sorted((r.drawing_id, r.mine, bytes(r.bytes)) for r in corpus.slices(spans).collect())
    assert got == [(d, i, rec("P", i, *at).encode()) for d in "01" for i, at in ((1, (0, 0)), (2, (3, 4)))]
    odd = spark.createDataFrame([("0", 0, 2), ("0", None, 1), ("2", 0, 2)], "drawing_id string, offset long, length long")
    assert sorted((r.drawing_id, r.offset is None, bytes(r.bytes or b"")) for r in corpus.slices(odd).collect()) == [("0", False, data[:2]), ("0", True, b""), ("2", False, b"no")]
    sources = {r.drawing_id: bytes(r.source) for r in corpus.logical.collect()}
    assert sources["0"] == sources["1"] == data and sources["2"] == b"no drawing"


def test_text_errors_name_the_bad_byte_under_mixed_line_ends(spark):
    text = rec(*tex(4, "ab\xffc")).replace("\n", "\r\n", 3)
    data = drawing(section(1, "ENCODING: utf-8\r\n"), head(), section(62, text)).decode().encode("latin-1")
    corpus = read(spark, data)
    found = corpus.diagnostics.where("code = 'MI_TEXT_DECODE_ERROR'").select("drawing_id", "span.offset", "span.length")
    assert [bytes(r.bytes) for r in corpus.slices(found).collect()] == [b"\xff"] and data.count(b"\xff") == 1


def test_reports_are_made_by_executors(spark):
    rows = {r.drawing_id: (json.loads(r.report), r.failed) for r in read(spark, drawing(head(), POINTS), b"none").inspect(records=True, lines=True).collect()}
    report, failed = rows["0"]
    assert not failed and [x["type"] for x in report["records"] if x.get("type")] == ["P", "P"] and len(report["lines"]) == report["line_count"] and report["record_types"] == {"P": 2}
    assert rows["1"][1] and rows["1"][0]["error"]["class"] == "InvalidDrawing" and rows["1"][0]["lines"] == []


def test_deep_trees(spark):
    """A chain of parts, from every caller."""
    chain = [asse(10 + i, f"P{i}", *([child(11 + i, 1, 0)] if i < 6 else [])) for i in range(7)]
    data = drawing(head(), section(5, *chain), *[section(6, f"P{i}\n") for i in range(7)], POINTS, LINE)
    assert read(spark, data).placed_lines().count() == 1
    assert read(spark, data).polylines(4, expand=True).count() == 1
