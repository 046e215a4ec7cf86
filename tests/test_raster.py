"""Previews: pixels against plain loops, images decoded, results that don't depend on partitions."""

import math
import struct
import zlib

import numpy as np
import pytest
from drawing import asse, child, drawing, head, rec, section, tex

import sparkdraw
from sparkdraw.operators import raster



def decoded(data):
    """Pixels of an RGB PNG whose lines are unfiltered."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, body = 8, b""
    while at < len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(data[at + 4 : at + 8 + n])
        if name == b"IHDR":
            width, height = struct.unpack(">II", data[at + 8 : at + 16])
        if name == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + 3 * width)
    assert not lines[:, 0].any()
    return lines[:, 1:].reshape(height, width, 3)


def color(image, x, y):
    return "#" + bytes(image[y, x]).hex()


STROKES = "drawing_id string, mi_type string, vertices array<struct<x:double,y:double>>"


def test_pixels_are_those_near_the_segment():
    rng = np.random.default_rng(5)
    for size in (1, 2, 3, 6):
        for a, b in rng.uniform(-40, 80, (40, 2, 2)):
            got = raster.covered(a[None], b[None], 40, 30, size)
            near = []
            for p in range(40 * 30):
                q = np.array([p % 40, p // 40], float)
                t = np.clip(((q - a) @ (b - a)) / ((b - a) @ (b - a)), 0, 1)
                near.append(np.hypot(*(q - a - t * (b - a))))
            near = np.array(near)
            # Steps of a pixel and rounding move a brush by less than a pixel and a half.
            assert (near[got] <= size / 2 + 1.5).all() and set(np.flatnonzero(near < size / 2 - 1.5)) <= set(got)
            if size == 1 and near.min() < 0.2:
                assert len(got)


def test_long_segments_are_clipped_before_they_are_sampled():
    a, b = np.array([[-1e12, 5.0], [3.0, -1e300], [math.nan, 1], [0, 0]]), np.array([[1e12, 5.0], [3.0, 1e300], [1, 1], [math.inf, 0]])
    got = raster.covered(a, b, 10, 8, 1)
    assert sorted(got) == sorted({50 + x for x in range(10)} | {10 * y + 3 for y in range(8)})


def test_images(spark):
    rows = [
        ("a", "LIN", [(0.0, 0.0), (100.0, 0.0)]), ("a", "CIR", [(50.0, -50.0), (50.0, 50.0)]), ("a", "NEW", [(0.0, 50.0), (100.0, 50.0), (math.nan, 0.0), (0.0, 20.0), (0.0, 30.0)]),
        ("a", "P", [(100.0, -50.0)]), ("b", "LIN", [(7.0, 7.0), (7.0, 7.0)]), ("c", "LIN", []), ("d", "LIN", [(math.inf, 1.0)]),
    ]
    df = spark.createDataFrame(rows, STROKES)
    look = {"width": 121, "height": 121, "margin": 10, "dot": 3}
    found = {}
    for n in (1, 7):
        pixels = raster.painted(df.repartition(n), **look)
        found[n] = {r["drawing_id"]: (r["width"], r["height"], bytes(r["png"])) for r in raster.images(pixels, 121, 121).collect()}
    assert found[1] == found[7] and set(found[1]) == {"a", "b"}
    image = decoded(found[1]["a"][2])
    blue, green, pink = "#1f2937", "#059669", "#db2777"
    assert image.shape == (121, 121, 3) and color(image, 10, 60) == blue == color(image, 110, 60) and color(image, 9, 60) == color(image, 111, 60) == color(image, 10, 61) == "#ffffff"
    # LIN comes after CIR, so it is on top where they cross; unknown kinds are black and below both.
    assert color(image, 60, 60) == blue and color(image, 60, 61) == green and color(image, 60, 10) == green and color(image, 20, 10) == "#000000"
    assert color(image, 10, 35) == "#000000" and color(image, 40, 37) == "#ffffff"
    assert color(image, 110, 110) == color(image, 109, 110) == color(image, 110, 111) == pink and color(image, 108, 110) == "#ffffff"
    dot = decoded(found[1]["b"][2])
    assert color(dot, 60, 60) == blue and (dot != 255).any(2).sum() == 1
    red = decoded(bytes(raster.images(raster.painted(df, (0, 0, 10, 10), {"LIN": "#ff0000"}, 11, 11, 0), 11, 11).where("drawing_id = 'a'").first()["png"]))
    assert [color(red, x, 10) for x in range(11)] == ["#ff0000"] * 11 and (red[:10, 1:] == 255).all()
    assert raster.images(raster.painted(df.limit(0))).count() == 0


def test_previews_of_a_corpus(spark):
    data = drawing(head(), section(5, asse(10, "TOP", child(11, 0, 50)), asse(11, "LEAF")), section(6, "TOP\n"), section(6, "LEAF\n"), section(61, rec("P", 1, 0, 0), rec("P", 2, 100, 0)), section(62, rec("LIN", 3, 1, 0, 0.5, 9, 0, 1, 2)), section(71, tex_rec()))
    corpus = sparkdraw.read(spark, spark.createDataFrame([("x", data), ("y", b"broken")], "drawing_id string, content binary"))
    plain = {r["drawing_id"]: decoded(bytes(r["png"])) for r in corpus.previews(80, 60, texts=False).collect()}
    assert set(plain) == {"x"} and plain["x"].shape == (60, 80, 3) and (plain["x"] != 255).any(2).sum() == 60
    dots = decoded(bytes(corpus.previews(80, 60, points=True, texts=True).first()["png"]))
    assert {"#db2777", "#1f2937"} <= {"#" + bytes(p).hex() for p in dots.reshape(-1, 3)}
    corpus.close()


def tex_rec():
    return rec(*tex(20, "hello"))


def test_arguments(spark):
    df = spark.createDataFrame([], STROKES)
    for bad, error in (({"width": 0}, ValueError), ({"height": 2.5}, TypeError), ({"stroke": True}, TypeError), ({"margin": -1}, ValueError), ({"margin": 300}, ValueError), ({"dot": 0}, ValueError)):
        with pytest.raises(error):
            raster.painted(df, **bad)
