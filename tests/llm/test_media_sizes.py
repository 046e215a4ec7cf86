"""Images that claim impossible sizes, and images of other depths than 8 bits."""

import io

import numpy as np
import pytest

from sparkdraw.llm import media

BMP = b"BM" + (54).to_bytes(4, "little") + b"\0" * 4 + (54).to_bytes(4, "little") + (40).to_bytes(4, "little")
BAD = [
    b"P6 99999999999999999999999 1 255\n", b"P5 1000000000 1000000000 255\n", b"P4 99999999999 99999999999\n", b"P2 999999999999 9999999999 255\n1", b"P3 " + b"9" * 5000 + b" 1 255 1", b"P2 1 1 15\n99",
    b"P5 1 1 15\n\xff", b"P5 1 1 0\n\0", b"P5 1 1 65536\n\0\0", BMP + (2**31 - 1).to_bytes(4, "little") * 2 + b"\1\0\x18\0" + b"\0" * 24, BMP + (1).to_bytes(4, "little") * 2 + b"\1\0\x08\0" + b"\0" * 16 + b"\xff" * 4 + b"\0" * 8,
    b"BM", b"P6", b"\0", b"P5 1 1 255",
]


@pytest.mark.parametrize("data", BAD)
def test_bad_sizes_are_errors(data):
    with pytest.raises((ValueError, OverflowError)):
        media.decode_image(data)


def test_bad_images_do_not_end_the_job(spark):
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(BAD)] + [(99, bytearray(b"P5 1 1 255\n\7")), (100, None)], "doc_id long, media binary")
    rows = {r.doc_id: r for r in media.decode_media(df).collect()}
    assert all(rows[i].error and rows[i].samples is None for i in [*range(len(BAD)), 100]) and rows[99].error is None and bytes(rows[99].samples) == b"\7"


@pytest.mark.parametrize("data", [b"P2 2 1 15\n15 15", b"P5 2 1 65535\n\xff\xff\xff\xff", b"P3 1 1 7\n7 7 7", b"P5 2 1 300\n\x01\x2c\x01\x2c", b"P4 2 1\n\0", b"P1 1 1\n0"])
def test_white_is_white(spark, data):
    row = media.decode_media(spark.createDataFrame([(1, bytearray(data))], "doc_id long, media binary")).first()
    assert np.load(io.BytesIO(bytes(row.tile))).min() == 255 and row.error is None


def test_hash_and_tile_do_not_depend_on_depth():
    eight = np.random.default_rng(1).integers(0, 256, (20, 30), dtype=np.uint8)
    sixteen = eight.astype(np.uint16) * 257
    assert media.difference_hash(sixteen, 65535) == media.difference_hash(eight) and media.npy_tile(sixteen, most=65535) == media.npy_tile(eight)
