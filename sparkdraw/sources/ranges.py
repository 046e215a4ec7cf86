"""Framing of large drawings by many tasks.

A range is a stretch of whole records: it begins where a drawing begins, or after the line of a mark. Each
range is summarised alone; sums, last values and flags of the ranges before it are an associative scan over
these small rows, and give its ``Carry``: offset, line, counts, the open section and its part. With that
every range is framed by itself. Sections that cross ranges are put together from their pieces, and first
ids by an aggregation.

``aligned`` makes such ranges of pieces that were cut anywhere: what follows the last line end that is
certain (a carriage return at the very end may have its line feed in the next piece) moves on to the next
piece, then what follows the last mark does. The bytes themselves stay dealt out; only flags are put in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DrawingError
from . import scan as S
from .limits import Limits

KEY = "drawing_id"
_COUNTS = ("n_bytes", "n_lines", "lf", "crlf", "cr", "unterminated", "widest", "sections", "parts", "records", "entities", "largest", "open_records", "open_entities", "open_largest")
SUMMARY = T.StructType([
    T.StructField(KEY, T.StringType()), T.StructField("part", T.LongType()), *[T.StructField(n, T.LongType()) for n in _COUNTS], T.StructField("number", T.LongType()), T.StructField("parts_then", T.LongType()),
    T.StructField("preamble", S.SPAN), T.StructField("terminator", S.SPAN), T.StructField("head", S.DRAWING["format"].dataType), T.StructField("trouble", T.StringType()),
])
_FREE = Limits(**{k: 1 << 62 for k in Limits.__dataclass_fields__})


# Alignment


def last_line_end(data: bytes) -> int:
    """Where the last line that surely ends here does; 0 if none."""
    return max(data.rfind(b"\n"), data.rfind(b"\r", 0, max(0, len(data) - 1))) + 1


def last_mark_end(data: bytes) -> int:
    """Where the line of the last mark ends, in data made of whole lines; 0 if there is none. Lines after an end mark count as they are."""
    at = 0
    for m in S._MARK.finditer(data):
        at = m.end()
    return S._END.search(data, at).end() if at else 0


def _moved(pieces: DataFrame, cut: Callable[[bytes], int], keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Pieces (drawing_id, part, content) in which what follows a cut has moved to the next piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [x or b"" for x in batch.column("content").to_pylist()]
            at = [cut(x) for x in data]
            columns = [pa.array([x[:i] for x, i in zip(data, at, strict=True)], pa.binary()), pa.array([x[i:] for x, i in zip(data, at, strict=True)], pa.binary()), pa.array([i > 0 for i in at], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(KEY), batch.column("part"), *columns], names=[KEY, "part", "body", "tail", "ends"])

    halves = keep(pieces.select(KEY, "part", "content").mapInArrow(run, f"{KEY} string, part long, body binary, tail binary, ends boolean"), "pieces")
    before = F.coalesce(F.sum(F.col("ends").cast("long")).over(Window.partitionBy(KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = halves.select(KEY, "part", "ends").withColumn("to", before).select(KEY, "part", "to", (F.col("to") + F.col("ends").cast("long")).alias("rest"))
    half = lambda to, half, name: F.struct(F.col(to).alias("to"), F.lit(half).alias("half"), F.col(name).alias("bytes"))
    rows = halves.join(dealt, [KEY, "part"]).select(KEY, "part", F.explode(F.array(half("to", 0, "body"), half("rest", 1, "tail"))).alias("h"))
    rows = rows.select(KEY, F.col("h.to").alias("to"), F.struct("part", "h.half", F.col("h.bytes").cast("string").alias("bytes")).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["bytes"]), "").cast("binary")
    return rows.groupBy(KEY, F.col("to").alias("part")).agg(joined.alias("content"))


def aligned(pieces: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Ranges (drawing_id, part, content) of drawings that come in pieces cut anywhere; parts give their order. keep: writes a table and reads it back."""
    return _moved(_moved(pieces, last_line_end, keep), last_mark_end, keep).where((F.octet_length("content") > 0) | (F.col("part") == 0))


# What comes before each range


def summaries(ranges: DataFrame) -> DataFrame:
    """A row of SUMMARY a range. Records before the first mark of a section count apart: they are records only if a section is open."""

    def one(who: str, part: int, data: bytes) -> dict:
        # As if a section were open; nothing of it is the last range's, so no rest is taken for a record.
        frame = S.Frame(data, _FREE, S.Carry(open=0, sections=1, offset=min(part, 1)), last=False)
        carried = [r for r in frame.records if r[1] == 0]
        rest = frame.records[len(carried) :]
        started = [p for p in frame.sections if p["at"] is not None]
        head = trouble = None
        if part == 0:
            try:
                head = S.head_of(data)
            except DrawingError as bad:
                trouble = str(bad)
        size = lambda rows: max((r[5] for r in rows), default=0)
        ids = lambda rows: sum(r[18] is not None for r in rows)
        shift = lambda span: span and span | {"offset": span["offset"] - min(part, 1)}
        first = started[0] if started else None
        return {
            KEY: who, "part": part, "n_bytes": len(data), "n_lines": len(frame.starts), **dict(zip(("lf", "crlf", "cr", "unterminated"), frame.counts, strict=True)), "widest": frame.widest, "sections": len(started),
            "parts": sum(p["number"] == 6 for p in started), "records": len(rest), "entities": ids(rest), "largest": size(rest), "open_records": len(carried), "open_entities": ids(carried), "open_largest": size(carried),
            "number": started[-1]["number"] if started else None, "parts_then": sum(p["number"] == 6 for p in started), "terminator": shift(frame.terminator), "head": head, "trouble": trouble,
            "preamble": first and S._span(0, first["at"] - min(part, 1), 1, first["line"]),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = S.to_arrow_schema(SUMMARY)
        for batch in batches:
            rows = [one(*x) for x in zip(*[batch.column(c).to_pylist() for c in (KEY, "part", "content")], strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return ranges.select(KEY, "part", "content").mapInArrow(run, SUMMARY)


def carries(found: DataFrame) -> DataFrame:
    """(drawing_id, part, carry, last, totals): an associative scan over summaries; ranges after the end mark have no structure."""
    order = Window.partitionBy(KEY).orderBy("part")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(KEY)
    sums = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    ended = F.coalesce(F.max(F.col("terminator").isNotNull()).over(before), F.lit(False))
    rows = found.withColumn("ended", ended).withColumn("alive", F.when(F.col("ended"), 0).otherwise(1))
    rows = rows.withColumn("c_parts", sums(F.col("parts") * F.col("alive")))
    at = F.when((F.col("alive") == 1) & F.col("number").isNotNull(), F.struct("number", (F.col("c_parts") + F.col("parts_then")).alias("parts")))
    rows = rows.withColumn("open", F.when(~F.col("ended"), F.last(at, ignorenulls=True).over(before)))
    held = lambda own, opened: F.col("alive") * (F.col(own) + F.when(F.col("open").isNotNull(), F.col(opened)).otherwise(0))
    rows = rows.withColumns({"all_records": held("records", "open_records"), "all_entities": held("entities", "open_entities"), "all_sections": F.col("sections") * F.col("alive")})
    rows = rows.withColumn("all_largest", F.col("alive") * F.greatest("largest", F.when(F.col("open").isNotNull(), F.col("open_largest")).otherwise(0)))
    parts = F.col("open.parts")
    carry = F.struct(
        sums("n_bytes").alias("offset"), sums("n_lines").alias("line"), sums("all_sections").alias("sections"), sums("all_records").alias("records"), sums("all_entities").alias("entities"), F.col("c_parts").alias("parts"),
        F.col("open.number").alias("open"), F.when((parts > 0) & F.col("open.number").isin(*S.PART_SECTIONS), parts - 1).alias("part"), F.col("ended").alias("ended"),
    )
    rows = rows.withColumn("carry", carry)

    def moved(span: str) -> Column:
        here = F.col(span)
        return F.when(here.isNotNull(), F.struct((here["offset"] + F.col("carry.offset")).alias("offset"), here["length"].alias("length"), *[(here[n] + F.col("carry.line")).alias(n) for n in ("start_line", "end_line")]))

    first = F.col("preamble")
    length = F.col("carry.offset") + first["length"]
    preamble = F.when(
        (F.col("carry.sections") == 0) & (F.col("alive") == 1) & first.isNotNull(),
        F.struct(F.lit(0).cast("long").alias("offset"), length.alias("length"), F.lit(1).cast("long").alias("start_line"), F.when(length > 0, F.greatest(F.lit(1), first["end_line"] + F.col("carry.line") - 1)).otherwise(1).cast("long").alias("end_line")),
    )
    rows = rows.withColumns({"preamble": preamble, "terminator": F.when(F.col("alive") == 1, moved("terminator"))})
    total = lambda c, f=F.sum: f(c).over(every)
    totals = F.struct(
        total("n_bytes").alias("size"), total("n_lines").alias("lines"), F.array(*[total(c) for c in ("lf", "crlf", "cr", "unterminated")]).alias("counts"), total("widest", F.max).alias("widest"), total("all_largest", F.max).alias("largest"),
        total("all_sections").alias("sections"), total("all_records").alias("records"), total("preamble", F.max).alias("preamble"), total("terminator", F.max).alias("terminator"), total("head", F.max).alias("head"), total("trouble", F.max).alias("trouble"),
    )
    # What stands behind the last mark is the last range's own, so it is framed with the drawing's end in view.
    return rows.select(KEY, "part", "carry", (F.col("part") == total("part", F.max)).alias("last"), totals.alias("totals"))


# Framing

_PIECE = T.StructType([
    *[T.StructField(n, T.LongType()) for n in ("section_index", "number", "part_index", "at", "line", "marker_end", "first_record", "end", "row", "records_then")],
    T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("field_at", T.ArrayType(T.LongType())), T.StructField("odd", T.BooleanType()),
])
_FRAMED = T.StructType([*[f for f in S.SCAN_SCHEMA if f.name not in ("section", "range")], T.StructField("piece", _PIECE), T.StructField("part", T.LongType())])


def _read(row: dict, limits: Limits) -> tuple[S.Frame, tuple[dict, list[dict]] | None]:
    """The frame of a range, and with the first one the drawing's row and remarks; raises what is wrong with the whole drawing."""
    totals = row["totals"]
    if totals["trouble"] is not None:
        raise S.InvalidDrawing(totals["trouble"])
    S.check_totals(limits, **{k: totals[k] for k in ("size", "lines", "widest", "largest", "sections", "records")})
    frame = S.Frame(row["content"], limits, S.Carry(**row["carry"]), row["last"])
    if row["part"]:
        return frame, None
    container = totals["size"] if row["container_size"] is None else row["container_size"]
    made = S.drawing_row(totals["head"], row["compression"], container, totals["size"], totals["counts"], totals["preamble"], totals["terminator"])
    return frame, (made, S.whole_notes(made))


def framed(ranges: DataFrame, limits: Limits, failfast: bool) -> DataFrame:
    """Rows of ranges (with carry, last and totals); sections as pieces."""
    schema = S.to_arrow_schema(_FRAMED)

    def told(batch: pa.RecordBatch, part: int, pieces: bool) -> pa.RecordBatch:
        at = dict(zip(batch.schema.names, batch.columns, strict=True))
        n = len(batch)
        return pa.RecordBatch.from_arrays([at["section"] if f.name == "piece" and pieces else pa.array([part] * n, pa.int64()) if f.name == "part" else at.get(f.name, pa.nulls(n, f.type)).cast(f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = schema.field("piece").type
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    frame, head = _read(row, limits)
                except DrawingError as bad:
                    if failfast:
                        raise
                    if row["part"] == 0:
                        yield told(S.error_row(row[KEY], row["container_size"], bad), 0, False)
                    continue
                out = S.Gathered()
                for some in (*out.add(row[KEY], frame, [], None, head), *out.rest()):
                    yield told(some, row["part"], False)
                if frame.sections:
                    n = len(frame.sections)
                    have = {KEY: pa.array([row[KEY]] * n), "row": pa.array(["section"] * n), "piece": pa.array(frame.sections, piece), "part": pa.array([row["part"]] * n, pa.int64())}
                    yield pa.RecordBatch.from_arrays([have.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    return ranges.mapInArrow(run, _FRAMED)


def sections(pieces: DataFrame) -> DataFrame:
    """(drawing_id, section) of pieces (drawing_id, part, piece): one row a section."""
    p = lambda n: F.col(f"piece.{n}")
    listed = F.array_sort(F.collect_list(F.when(p("fields").isNotNull(), F.struct("part", p("fields").alias("fields"), p("field_at").alias("field_at")))))
    own = {n: F.max(p(n)).alias(n) for n in ("number", "part_index", "at", "line", "marker_end", "first_record", "end", "row")}
    rows = pieces.groupBy(KEY, p("section_index").alias("section_index")).agg(*own.values(), F.max(F.when(p("row").isNotNull(), p("records_then"))).alias("then"), listed.alias("listed"), F.max(p("odd")).alias("odd"))
    span = lambda offset, length, start, end: F.struct(*[x.cast("long").alias(n) for x, n in zip((offset, length, start, end), ("offset", "length", "start_line", "end_line"), strict=True)])
    at, line, body = F.col("at"), F.col("line"), F.col("marker_end")
    last, size = F.greatest(F.col("row") - 1, line), F.col("end") - body
    flat = lambda name: F.when(F.size("listed") > 0, F.flatten(F.transform("listed", lambda x: x[name])))
    section = F.struct(
        "section_index", "number", span(at, F.col("end") - at, line, last).alias("span"), span(at, body - at, line, line).alias("marker_span"),
        F.when(size > 0, span(body, size, line + 1, last)).otherwise(span(body, F.lit(0), line, line)).alias("body_span"), "first_record", (F.col("then") - F.col("first_record")).alias("record_count"), "part_index",
        flat("fields").alias("fields"), flat("field_at").alias("field_at"), "odd",
    )
    return rows.select(KEY, section.alias("section"))


def scan(ranges: DataFrame, limits: Limits, failfast: bool, keep: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Rows of SCAN_SCHEMA of ranges (drawing_id, part, content, container_size, compression), and the ranges with what comes before each. keep: writes a table and reads it back."""
    ready = keep(ranges.join(carries(summaries(ranges)), [KEY, "part"]), "ranges")
    rows = keep(framed(ready, limits, failfast), "framed")
    none = lambda f: F.lit(None).cast(f.dataType).alias(f.name)
    first = rows.where("entity_id is not null").groupBy(KEY, "entity_id").agg(F.min("entity_index").alias("first_index"))
    plain = rows.where("row <> 'section'").drop("first_index").join(first, [KEY, "entity_id"], "left")
    plain = plain.select(*[F.col(f.name) if f.name in plain.columns else none(f) for f in S.SCAN_SCHEMA])
    whole = sections(rows.where("row = 'section'")).withColumn("row", F.lit("section"))
    return plain.unionByName(whole.select(*[F.col(f.name) if f.name in whole.columns else none(f) for f in S.SCAN_SCHEMA])), ready


def lines(ready: DataFrame, limits: Limits) -> DataFrame:
    """Every physical line of ranges with what comes before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    frame, _ = _read(row, limits)
                except DrawingError:
                    continue
                yield from S.line_rows(row[KEY], frame)

    return ready.mapInArrow(run, S.LINE_SCHEMA)


__all__ = ["aligned", "carries", "framed", "lines", "scan", "sections", "summaries"]
