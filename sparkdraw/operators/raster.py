"""Previews painted on executors: polylines and marks become pixels, pixels become PNG images, one row a drawing.

Shapes are painted where they are: a task turns each batch into distinct pixels, an aggregation by drawing and
pixel keeps what is on top, and only then are a drawing's pixels brought together, width * height at most,
however many shapes it has. Result and cost don't depend on how shapes are dealt to tasks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .polylines import DEFAULT_COLORS
from .resolve import KEY

WIDTH, HEIGHT, MARGIN, STROKE, DOT = 800, 600, 10, 1, 5
BLACK, WHITE = 0x000000, 0xFFFFFF
#: Samples along segments that a task holds at a time.
SAMPLES = 2_000_000
#: Length of a text's stroke for each character, in heights.
ADVANCE = 0.6
_BOX = ["x0", "y0", "x1", "y1"]


def check(**sizes: int) -> None:
    """Refuse sizes that are no whole numbers above zero (margin: from zero), before a plan exists."""
    for name, value in sizes.items():
        if not isinstance(value, int) or isinstance(value, bool):
            raise TypeError(f"{name}: {value!r} is no whole number")
        if value < (name != "margin"):
            raise ValueError(f"{name}: {value!r} is out of range")
    if 2 * sizes.get("margin", 0) >= min(sizes.get("width", 1 << 30), sizes.get("height", 1 << 30)):
        raise ValueError("margin: no room is left")


def strokes(shapes: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """(drawing_id, mi_type, vertices) of shapes that have vertices, and of marks: a point is one vertex; a text is a stroke along its baseline, as long as its characters."""
    out = shapes.where("vertices is not null").select(KEY, "mi_type", "vertices")
    if marks is None:
        return out
    far = F.col("height") * ADVANCE * F.char_length("text")
    end = F.struct((F.col("at.x") + far * F.cos("rotation")).alias("x"), (F.col("at.y") + far * F.sin("rotation")).alias("y"))
    start = F.struct(F.col("at.x").alias("x"), F.col("at.y").alias("y"))
    return out.unionByName(marks.where("at is not null").select(KEY, "mi_type", F.when(F.col("text").isNull(), F.array(start)).otherwise(F.array(start, end)).alias("vertices")))


def boxes(rows: DataFrame) -> DataFrame:
    """(drawing_id, x0, y0, x1, y1) of all vertices that are finite."""
    finite = lambda v: (F.abs(v["x"]) < float("inf")) & (F.abs(v["y"]) < float("inf"))
    inner = rows.select(KEY, F.filter("vertices", finite).alias("v"))
    side = lambda n: F.transform("v", lambda p: p[n])
    ends = [F.min(F.array_min(side("x"))), F.min(F.array_min(side("y"))), F.max(F.array_max(side("x"))), F.max(F.array_max(side("y")))]
    return inner.groupBy(KEY).agg(*[e.alias(n) for e, n in zip(ends, _BOX, strict=True)]).where("x0 is not null")


def clipped(a: np.ndarray, b: np.ndarray, width: int, height: int, pad: float) -> tuple[np.ndarray, np.ndarray]:
    """The parts of segments a to b (rows of x, y) within the image and ``pad`` around it."""
    keep = np.isfinite(a).all(1) & np.isfinite(b).all(1)
    a, b = a[keep], b[keep]
    for axis, most in ((0, width - 1 + pad), (1, height - 1 + pad)):
        for edge, sign in ((-pad, 1), (most, -1)):
            # What lies beyond an edge ends on it, exactly; halves keep the largest numbers finite.
            out_a, out_b = ((x[:, axis] - edge) * sign < 0 for x in (a, b))
            keep = ~(out_a & out_b)
            a, b, out_a, out_b = a[keep], b[keep], out_a[keep], out_b[keep]
            for ends, others, out in ((a, b, out_a), (b, a, out_b)):
                t = (edge / 2 - ends[out, axis] / 2) / (others[out, axis] / 2 - ends[out, axis] / 2)
                cross = 1 - axis
                ends[out, cross] = ends[out, cross] * (1 - t) + others[out, cross] * t
                ends[out, axis] = edge
    return a, b


def disc(size: int) -> np.ndarray:
    """Offsets (x, y) of the pixels of a brush of ``size`` pixels across."""
    side = np.arange(size) - (size - 1) // 2
    x, y = (v.ravel() for v in np.meshgrid(side, side))
    middle = 0.5 if size % 2 == 0 else 0.0
    return np.stack([x, y], 1)[(x - middle) ** 2 + (y - middle) ** 2 <= (size / 2) ** 2]


def covered(a: np.ndarray, b: np.ndarray, width: int, height: int, size: int) -> np.ndarray:
    """Distinct pixels (y * width + x) under a brush drawn from each a to its b: steps of a pixel at most along the longer side."""
    a, b = clipped(a, b, width, height, size)
    steps = np.ceil(np.abs(b - a).max(1, initial=0)).astype(np.int64) + 1
    out = []
    begin = 0
    total = np.cumsum(steps)
    while begin < len(a):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + SAMPLES, "right")))
        n = steps[begin:end]
        which = np.repeat(np.arange(begin, end), n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        t = at / np.maximum(np.repeat(n, n) - 1, 1)
        middle = np.unique(np.floor(a[which] + (b - a)[which] * t[:, None] + 0.5).astype(np.int64), axis=0)
        for dx, dy in disc(size).tolist():
            x, y = middle[:, 0] + dx, middle[:, 1] + dy
            inside = (x >= 0) & (x < width) & (y >= 0) & (y < height)
            out.append(np.unique(y[inside] * width + x[inside]))
        begin = end
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def painted(rows: DataFrame, window: tuple[float, float, float, float] | None = None, colors: dict[str, str] | None = None, width: int = WIDTH, height: int = HEIGHT, margin: int = MARGIN, stroke: int = STROKE, dot: int = DOT) -> DataFrame:
    """(drawing_id, pixel, color) of strokes: pixel is y * width + x from the top left, color a number 0xRRGGBB. Both axes have one scale, and the window (each drawing's own box, if none is given) is in the middle.

    Kinds paint in order of their names, later ones on top. Vertices that aren't finite break a polyline.
    """
    check(width=width, height=height, margin=margin, stroke=stroke, dot=dot)
    palette = {k: int(v.removeprefix("#"), 16) for k, v in (DEFAULT_COLORS | (colors or {})).items()}
    if window is None:
        rows = rows.join(boxes(rows), KEY)
    else:
        rows = rows.withColumns({n: F.lit(float(v)) for n, v in zip(_BOX, window, strict=True)})
    names = sorted(palette)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who = np.array(batch.column(KEY).to_pylist(), object)
            kinds = batch.column("mi_type").to_pylist()
            box = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in _BOX], 1)
            lists = batch.column("vertices")
            flat = lists.flatten()
            xy = np.stack([flat.field(n).to_numpy(zero_copy_only=False).astype(float) for n in "xy"], 1)
            shape = np.repeat(np.arange(len(batch)), np.array(lists.value_lengths().fill_null(0)))
            # A scale for each shape, the same for all shapes of a drawing.
            room = np.array([width - 1 - 2 * margin, height - 1 - 2 * margin], float)
            span = box[:, 2:] - box[:, :2]
            with np.errstate(divide="ignore"):
                scale = np.min(np.where(span > 0, room / span, np.inf), 1)
            scale = np.where(np.isfinite(scale), scale, 1.0)
            moved = (xy - (box[shape, :2] + box[shape, 2:]) / 2) * scale[shape, None]
            at = np.stack([(width - 1) / 2 + moved[:, 0], (height - 1) / 2 - moved[:, 1]], 1)
            # Vertices by drawing and kind; those of a shape stay together.
            groups: dict[tuple, int] = {}
            group = np.array([groups.setdefault(key, len(groups)) for key in zip(who.tolist(), kinds, strict=True)])
            order = np.argsort(group[shape], kind="stable")
            cuts = np.searchsorted(group[shape][order], np.arange(len(groups) + 1))
            sizes = np.bincount(shape, minlength=len(batch))
            for (drawing, kind), g in groups.items():
                mine = order[cuts[g] : cuts[g + 1]]
                points, of = at[mine], shape[mine]
                follows = of[1:] == of[:-1]
                pixels = [covered(points[:-1][follows], points[1:][follows], width, height, stroke)]
                if (alone := points[sizes[of] == 1]).size:
                    pixels.append(covered(alone, alone, width, height, dot))
                pixel = np.unique(np.concatenate(pixels))
                rank = names.index(kind) + 1 if kind in palette else 0
                paint = rank << 24 | palette.get(kind, BLACK)
                if len(pixel):
                    yield pa.RecordBatch.from_arrays([pa.array([drawing] * len(pixel), pa.string()), pa.array(pixel.astype(np.int32)), pa.array(np.full(len(pixel), paint, np.int64))], names=[KEY, "pixel", "paint"])

    made = rows.select(KEY, "mi_type", "vertices", *_BOX).mapInArrow(run, f"{KEY} string, pixel int, paint long")
    return made.groupBy(KEY, "pixel").agg(F.max("paint").alias("paint")).select(KEY, "pixel", F.col("paint").bitwiseAND(F.lit(WHITE)).cast("int").alias("color"))


def png(pixels: np.ndarray) -> bytes:
    """A PNG of an array (height, width, 3) of bytes."""
    height, width, _ = pixels.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], 1)

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def images(pixels: DataFrame, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """(drawing_id, width, height, png) of painted pixels on white; a drawing without any has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                rows = batch.column("pixels")[i].values
                field = np.full((height * width, 3), 255, np.uint8)
                color = rows.field("color").to_numpy()
                field[rows.field("pixel").to_numpy()] = np.stack([color >> 16, color >> 8 & 255, color & 255], 1)
                image = png(field.reshape(height, width, 3))
                yield pa.RecordBatch.from_arrays([batch.column(KEY).slice(i, 1), pa.array([width], pa.int32()), pa.array([height], pa.int32()), pa.array([image], pa.binary())], names=[KEY, "width", "height", "png"])

    packed = pixels.groupBy(KEY).agg(F.collect_list(F.struct("pixel", "color")).alias("pixels"))
    return packed.mapInArrow(run, f"{KEY} string, width int, height int, png binary")
