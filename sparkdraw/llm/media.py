"""Media columns: Netpbm and BMP images in binary columns.

Images are decoded to numpy arrays, resized by area with integral images, and written as NPY tiles
with a difference hash. ``text_to_image`` stores a text as the samples of a binary PPM image.

Null text counts as empty. A null or malformed image gives null results and a reason in ``error``, whatever
size it claims. Samples are given as stored; tiles and hashes take the largest possible sample as white.
"""

from __future__ import annotations

import io
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, with_arrow

#: Pixels a row of the images that hold texts; three samples each.
WIDTH = 64
#: Side of an NPY tile.
TILE = 32
_SPACE = rb"(?:[ \t\n\v\f\r]|#[^\n]*\n)+"
_HEAD = re.compile(rb"P([1-6])" + _SPACE + rb"(\d+)" + _SPACE + rb"(\d+)")
_MAX = re.compile(_SPACE + rb"(\d+)")


def _samples(data: bytes, at: int, count: int, kind: str) -> np.ndarray:
    """count samples from place at; a size that the data cannot hold is an error before anything is made of it."""
    if count * np.dtype(kind).itemsize > len(data) - at:
        raise ValueError("too few samples")
    return np.frombuffer(data, kind, count, at)


def _netpbm(data: bytes) -> tuple[np.ndarray, int]:
    """The image and its largest possible sample."""
    head = _HEAD.match(data)
    if not head:
        raise ValueError("no Netpbm header")
    kind, width, height = (int(x) for x in head.groups())
    if width < 1 or height < 1:
        raise ValueError("no pixels")
    at, most = head.end(), 1
    if kind not in (1, 4):
        found = _MAX.match(data, at)
        if not found:
            raise ValueError("no maxval")
        at, most = found.end(), int(found[1])
        if not 1 <= most <= 65535:
            raise ValueError("maxval out of range")
    shape = (height, width, 3) if kind in (3, 6) else (height, width)
    count = math.prod(shape)
    if kind <= 3:
        if count > len(data) - at:
            raise ValueError("too few samples")
        body = re.sub(rb"#[^\n]*", b" ", data[at:])
        found = re.findall(rb"[01]" if kind == 1 else rb"\d+", body)
        if len(found) < count:
            raise ValueError("too few samples")
        out = np.array([int(x) if len(x) < 8 else most + 1 for x in found[:count]]).reshape(shape)
    elif kind == 4:
        stride = (width + 7) // 8
        out = np.unpackbits(_samples(data, at + 1, stride * height, "u1").reshape(height, stride), axis=1)[:, :width]
    else:
        out = _samples(data, at + 1, count, "u1" if most < 256 else ">u2").reshape(shape)
    if kind in (1, 4):
        return (1 - out).astype(np.uint8) * np.uint8(255), 255
    if out.max() > most:
        raise ValueError("a sample above maxval")
    return out if kind > 3 else out.astype(np.uint8 if most < 256 else np.uint16), most


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array (height, width) or (height, width, 3), samples as stored; maxval up to 65535."""
    return _netpbm(data)[0]


def encode_ppm(pixels: np.ndarray) -> bytes:
    """A (height, width, 3) array of bytes as P6."""
    height, width, _ = pixels.shape
    return b"P6\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits as (height, width, 3) in R, G, B."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("no BMP header")
    offset, size = (int.from_bytes(data[i : i + 4], "little") for i in (10, 14))
    width, height = (int.from_bytes(data[i : i + 4], "little", signed=True) for i in (18, 22))
    bits, packing = int.from_bytes(data[28:30], "little"), int.from_bytes(data[30:34], "little")
    if packing != 0 or bits not in (1, 4, 8, 24, 32) or width < 1 or height == 0:
        raise ValueError("unsupported BMP")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    raw = _samples(data, offset, rows * stride, "u1").reshape(rows, stride)
    if bits >= 24:
        step = bits // 8
        out = raw[:, : width * step].reshape(rows, width, step)[:, :, 2::-1]
    else:
        used = int.from_bytes(data[46:50], "little") or 1 << bits
        palette = _samples(data, 14 + size, used * 4, "u1").reshape(used, 4)[:, 2::-1]
        per = 8 // bits
        shifts = np.arange(per - 1, -1, -1, dtype=np.uint8) * bits
        index = (raw[:, :, None] >> shifts & (1 << bits) - 1).reshape(rows, -1)[:, :width]
        if index.max() >= used:
            raise ValueError("colour outside the palette")
        out = palette[index]
    return out[::-1] if height > 0 else out


def encode_bmp(pixels: np.ndarray) -> bytes:
    """A (height, width, 3) array of bytes as a 24-bit BMP."""
    height, width, _ = pixels.shape
    stride = (width * 3 + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, width * 3)
    num = lambda *xs: b"".join(x.to_bytes(4, "little") for x in xs)
    head = b"BM" + num(54 + rows.size, 0, 54, 40, width, height) + b"\1\0\x18\0" + num(0, rows.size, 2835, 2835, 0, 0)
    return head + rows.tobytes()


def _image(data: bytes) -> tuple[np.ndarray, int]:
    return (decode_bmp(data), 255) if data[:2] == b"BM" else _netpbm(data)


def decode_image(data: bytes) -> np.ndarray:
    """Netpbm or BMP, told apart by content; samples as stored."""
    return _image(data)[0]


def integral(image: np.ndarray) -> np.ndarray:
    """Sums of all samples above and left of each corner, by plane."""
    planes = image[:, :, None] if image.ndim == 2 else image
    total = np.zeros((planes.shape[0] + 1, planes.shape[1] + 1, planes.shape[2]))
    np.cumsum(planes, axis=0, dtype=np.float64, out=total[1:, 1:])
    np.cumsum(total[1:, 1:], axis=1, out=total[1:, 1:])
    return total


def area_means(total: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target pixel's area, fractions of source pixels included, from an integral image."""
    rows, cols = total.shape[0] - 1, total.shape[1] - 1

    def at(values: np.ndarray, n: int, parts: int, axis: int) -> np.ndarray:
        edge = np.arange(parts + 1) * (n / parts)
        low = np.minimum(edge.astype(np.int64), n - 1)
        share = (edge - low).reshape([-1 if i == axis else 1 for i in range(3)])
        a, b = values.take(low, axis), values.take(low + 1, axis)
        return a + share * (b - a)

    corners = at(at(total, rows, height, 0), cols, width, 1)
    return np.diff(np.diff(corners, axis=0), axis=1) / (rows / height * cols / width)


def resize_area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    mean = area_means(integral(image), height, width)
    return mean[:, :, 0] if image.ndim == 2 else mean


def grey(image: np.ndarray, most: int = 255) -> np.ndarray:
    """Brightness from 0 to 255, of samples up to ``most``."""
    plane = image.astype(np.float64) if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])
    return plane * (255 / most) if most != 255 else plane


def _hash_of(total: np.ndarray) -> str:
    cells = np.round(area_means(total, 8, 9)[:, :, 0], 6)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def difference_hash(image: np.ndarray, most: int = 255) -> str:
    """64 bits as hex: whether each of 8 x 8 cells is darker than its right neighbour."""
    return _hash_of(integral(grey(image, most)))


def _tile_of(total: np.ndarray, side: int) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_means(total, side, side)[:, :, 0]), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def npy_tile(image: np.ndarray, side: int = TILE, most: int = 255) -> bytes:
    """A grey tile of side x side bytes in NPY form; ``most`` is white."""
    return _tile_of(integral(grey(image, most)), side)


def text_to_image(df: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """df with the text's UTF-8, filled up with spaces to whole pixel rows, as a PPM in ``media_col``."""
    row = WIDTH * 3

    def run(texts: list[str]):
        n_bytes, media = [], []
        for text in texts:
            raw = text.encode("utf-8", "surrogatepass")
            n_bytes.append(len(raw))
            raw += b" " * ((-len(raw)) % row if raw else row)
            media.append(encode_ppm(np.frombuffer(raw, np.uint8).reshape(-1, WIDTH, 3)))
        yield pa.array(n_bytes, pa.int64())
        yield pa.array(media, pa.binary())

    return with_arrow(df, text_col, [T.StructField("n_bytes", T.LongType()), T.StructField(media_col, T.BinaryType())], run)


def decode_media(df: DataFrame, media_col: str = "media", side: int = TILE) -> DataFrame:
    """df with samples (binary, row by row), height, width, tile (NPY), dhash and error of each image."""
    fields = [
        T.StructField("samples", T.BinaryType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()),
        T.StructField("tile", T.BinaryType()), T.StructField("dhash", T.StringType()), T.StructField("error", T.StringType()),
    ]
    new = {f.name for f in fields}
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new])
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 5 + ("no image",)
        try:
            image, most = _image(data)
        except (ValueError, IndexError, OverflowError, MemoryError) as bad:
            return (None,) * 5 + (str(bad) or type(bad).__name__,)
        total = integral(grey(image, most))
        return image.tobytes(), image.shape[0], image.shape[1], _tile_of(total, side), _hash_of(total), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, media_col):
                rows = [one(x) for x in part.column(media_col).to_pylist()]
                new = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *[f.name for f in fields]])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))
