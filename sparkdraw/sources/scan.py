"""Framing of drawings: an Arrow kernel that turns bytes into rows of sections and records.

The kernel frames a stretch of whole records, given what came before it (``Carry``). A drawing of usual size
is one stretch, framed in the task that reads it, without a shuffle. A larger one is cut after record marks
into ranges (``ranges`` composes what comes before each), so all cores frame it. Line ends come from array
operations over the bytes and marks from one pattern search; Python's loop runs over records, not over
lines. Spans are byte offsets and lengths in the logical stream, with 1-based lines.

Output rows have a ``row`` kind: "drawing", "section", "record", "diagnostic" or "range"; columns of other
kinds are null. ``LINE_SCHEMA`` rows come from a pass of their own. Encodings and texts are no matter of
framing: fields are strings of one character a byte.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import DrawingError, InvalidDrawing, LimitExceeded
from .files import unwrap
from .limits import Limits

BOM = b"\xef\xbb\xbf"
BLANK = " \t\n\f\r"
#: Sections whose records belong to the part that a section 6 before them defines.
PART_SECTIONS = frozenset((6, 61, 62, 63, 71, 72, 81, 82))
#: Sections in which every record needs a terminator.
FRAMED_SECTIONS = frozenset((41, 42, 5, 61, 62, 63, 71, 72, 81, 82))
#: Sections whose lines are read by position, and record types with text fields.
FIELD_SECTIONS = frozenset((1, 2, 3, 6))
TEXT_TYPES = frozenset(("TEX", "ASSP", "DTA", "DTV", "ASSE", "DANG", "DCHMF", "DDIA", "DRAD", "DSGL"))
RECORDS_A_BATCH = 20_000
#: Drawings of so many bytes share a batch.
BYTES_A_BATCH = 1 << 20
#: Fewer bytes have few lines.
SMALL = 2048
#: Drawings with more bytes are cut into ranges of about as many.
RANGE = 16 << 20

_MARK = re.compile(rb"(?:(?<=\n)|(?<=\r)|\A(?:\xef\xbb\xbf)?)[ \t\f]*(\|~|##~~|#~([0-9]+))[ \t\f]*(?=[\r\n]|\Z)")
_END = re.compile(rb"\r\n|\r|\n|\Z")
_TYPE = re.compile(r"[A-Za-z][A-Za-z0-9_]*")
_ID = re.compile(r"\+?[0-9]+")

SPAN = T.StructType([T.StructField(n, T.LongType()) for n in ("offset", "length", "start_line", "end_line")])
_s, _l, _i, _b = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
_strings = T.ArrayType(_s)
DIAGNOSTIC = T.StructType([T.StructField("phase", _i), T.StructField("ordinal", _l), T.StructField("seq", _l), *[T.StructField(n, _s) for n in ("severity", "code", "message")], T.StructField("span", SPAN)])
DRAWING = T.StructType([
    T.StructField("format", T.StructType([T.StructField("kind", _s), T.StructField("compression", _s), T.StructField("first_section", _l), T.StructField("utf8_bom", _b)])),
    *[T.StructField(n, _l) for n in ("container_size", "source_size")], T.StructField("termination", _s), T.StructField("end_offset", _l), T.StructField("trailing_bytes", _l),
    T.StructField("preamble_span", SPAN), T.StructField("file_terminator_span", SPAN),
    T.StructField("newlines", T.StructType([T.StructField(n, _l) for n in ("lf", "crlf", "cr", "unterminated")])), T.StructField("line_count", _l),
    T.StructField("error", T.StructType([T.StructField("class", _s), T.StructField("message", _s)])),
])
SECTION = T.StructType([
    T.StructField("section_index", _l), T.StructField("number", _l), T.StructField("span", SPAN), T.StructField("marker_span", SPAN), T.StructField("body_span", SPAN),
    T.StructField("first_record", _l), T.StructField("record_count", _l), T.StructField("part_index", _l), T.StructField("fields", _strings), T.StructField("field_at", T.ArrayType(_l)), T.StructField("odd", _b),
])
RECORD = [
    T.StructField("record_index", _l), T.StructField("section_index", _l), T.StructField("section_number", _l), T.StructField("part_index", _l),
    *[T.StructField(n, _l) for n in ("offset", "length", "start_line", "end_line", "payload_length", "payload_end_line", "terminator_offset", "terminator_length", "type_line")],
    T.StructField("termination", _s), T.StructField("record_type", _s), T.StructField("fields", _strings), T.StructField("field_at", T.ArrayType(_l)), T.StructField("odd", _b),
    T.StructField("entity_id", _l), T.StructField("entity_index", _l), T.StructField("first_index", _l),
]
RANGE_ROW = T.StructType([T.StructField("part", _l), T.StructField("content", T.BinaryType()), T.StructField("container_size", _l), T.StructField("compression", _s)])
SCAN_SCHEMA = T.StructType([
    T.StructField("drawing_id", _s), T.StructField("row", _s), T.StructField("drawing", DRAWING), T.StructField("section", SECTION), T.StructField("diagnostic", DIAGNOSTIC), T.StructField("range", RANGE_ROW), *RECORD,
])
LINE_SCHEMA = T.StructType([
    T.StructField("drawing_id", _s), *[T.StructField(n, _l) for n in ("number", "offset", "length", "content_length")], T.StructField("ending", _s), T.StructField("kind", _s),
    T.StructField("section_number", _l), T.StructField("content", T.BinaryType()),
])

_ENDINGS = np.array(["lf", "crlf", "cr", "none"])


def _span(offset: int, length: int, start: int, end: int) -> dict:
    return {"offset": offset, "length": length, "start_line": start, "end_line": end}


def _lines_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (with its line ending) of each line, and the index of its ending in _ENDINGS."""
    if len(data) < SMALL and b"\r" not in data:
        return _few_lines(data)
    b = np.frombuffer(data, np.uint8)
    lf, cr = b == 10, b == 13
    pair = np.zeros(len(b), bool)
    pair[:-1] = cr[:-1] & lf[1:]
    last = np.flatnonzero((lf | cr) & ~pair)
    kind = np.where(lf[last], 0, 2)
    after = last > 0
    kind[after] = np.where(pair[last[after] - 1], 1, kind[after])
    ends = last + 1
    if len(data) and (not len(ends) or ends[-1] < len(data)):
        ends, kind = np.append(ends, len(data)), np.append(kind, 3)
    return np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else np.zeros(0, np.int64), ends.astype(np.int64), kind


def _few_lines(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_lines_of a small drawing whose lines end in line feeds, for which array operations have more overhead than work."""
    ends = list(accumulate(len(x) + 1 for x in data.split(b"\n")))
    kind = np.zeros(len(ends), np.int64)
    # What follows the last line feed is a line if there is something.
    ends[-1] -= 1
    kind[-1] = 3
    if not data or data.endswith(b"\n"):
        ends.pop()
        kind = kind[:-1]
    return np.array([0, *ends][: len(ends)], np.int64), np.array(ends, np.int64), kind


def _split(raw: bytes) -> list[str]:
    """Lines of raw as strings of one character a byte, without the empty one after a final line end."""
    text = raw.decode("latin-1")
    parts = text.split("\n") if "\r" not in text else re.split(r"\r\n|\r|\n", text)
    if parts and parts[-1] == "":
        parts.pop()
    return parts


def _unsigned(text: str | None) -> int | None:
    """A strict id; null beyond the range of a signed 64-bit number."""
    if text is None or not _ID.fullmatch(text := text.strip(BLANK)):
        return None
    value = int(text)
    return value if value < 1 << 63 else None


class Carry(NamedTuple):
    """What stands before a stretch: bytes, lines, sections, records, entities and parts; the number and part of the section that is open; whether the drawing has ended."""

    offset: int = 0
    line: int = 0
    sections: int = 0
    records: int = 0
    entities: int = 0
    parts: int = 0
    open: int | None = None
    part: int | None = None
    ended: bool = False


def part_of(parts: int, number: int) -> int | None:
    """The part that a section belongs to, after so many definitions."""
    return parts - 1 if parts and number in PART_SECTIONS else None


def marks(data: bytes, first: bool = True) -> Iterator[tuple[int, int, str, int]]:
    """(start of the mark, end of its line, mark, section number) in order, up to and with the first end of file; first: data begins the drawing."""
    for m in _MARK.finditer(data):
        if m[2] is not None and int(m[2]) >= 1 << 32 or not first and m[0].startswith(BOM):
            continue
        yield m.start(1), _END.search(data, m.end()).end(), m[1].decode() if m[2] is None else "#~", -1 if m[2] is None else int(m[2])
        if m[1] == b"##~~":
            return


def cuts(data: bytes, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of data of about ``size`` bytes that end after the line of a mark; what follows the end mark is cut after lines."""
    begin = last = 0
    ended = False
    for _, after, mark, _ in marks(data):
        if after - begin > size and last > begin:
            yield begin, last
            begin = last
        last, ended = after, mark == "##~~"
    if ended and last < len(data):
        yield begin, last
        begin = last
        while len(data) - begin > size and 0 < (at := data.find(b"\n", begin + size) + 1) < len(data):
            yield begin, at
            begin = at
    yield begin, len(data)


class Frame:
    """The structure of a stretch of one drawing's logical bytes; ``last``: the drawing ends with it."""

    def __init__(self, data: bytes, limits: Limits, carry: Carry = Carry(), last: bool = True):
        self.data, self.limits, self.carry, self.last = data, limits, carry, last
        self.diagnostics: list[dict] = []
        self.sections: list[dict] = []
        self.records: list[tuple] = []
        self.entities = carry.entities
        self.starts, self.ends, self.kinds = _lines_of(data)
        self.counts = np.bincount(self.kinds, minlength=4).tolist()
        self.widest = int((self.ends - self.starts - np.array([1, 2, 1, 0])[self.kinds]).max(initial=0))
        self.ascii = data.isascii()
        self.terminator: dict | None = None
        self.preamble: dict | None = None
        if not carry.ended:
            self._frame()

    def note(self, code: str, message: str, span: dict) -> None:
        """A remark; what is said of the whole drawing comes first, the others by place."""
        self.diagnostics.append({"phase": 0, "ordinal": 0, "seq": 2 * span["offset"] + 1, "severity": "warning", "code": code, "message": message, "span": span})

    def _frame(self) -> None:
        data, starts, carry = self.data, self.starts.tolist(), self.carry
        base, before = carry.offset, carry.line
        section, parts = carry.sections - 1, carry.parts
        open_ = None  # the section under construction; what it has in this stretch
        if carry.open is not None:
            open_ = {"section_index": section, "number": carry.open, "part": carry.part, "body": 0, "next": 0, "next_line": before + 1}
        for at_mark, after, mark, number in marks(data, carry.offset == 0):
            line = bisect_right(starts, at_mark) - 1
            at, row = starts[line], before + line + 1
            if mark == "|~":
                if open_ is None:
                    self.note("MI_ENTITY_TERMINATOR_OUTSIDE_SECTION", "a record ends before any section", _span(base + at, after - at, row, row))
                else:
                    self._record(open_, at, row, after)
                    open_["next"], open_["next_line"] = after, row + 1
                continue
            if open_ is not None:
                self._close(open_, at, row, "section_boundary" if mark == "#~" else "file_boundary")
                open_ = None
            if mark == "#~":
                section += 1
                if section == 0:
                    self.preamble = _span(0, base + at, 1, max(1, row - 1) if base + at else 1)
                parts += number == 6
                open_ = {
                    "section_index": section, "number": number, "part": part_of(parts, number), "at": at, "line": row, "marker_end": after, "first_record": carry.records + len(self.records),
                    "body": after, "next": after, "next_line": row + 1,
                }
            else:
                self.terminator = _span(base + at, after - at, row, row)
        if open_ is not None and self.terminator is None:
            if self.last:
                self._close(open_, len(data), before + max(1 - before, len(starts)) + 1, "physical_eof")
            else:
                self._piece(open_, len(data), None)

    def _limit(self, what: str, actual: int, limit: int) -> None:
        if actual > limit:
            raise LimitExceeded(f"{what}: {actual} over {limit}")

    def _record(self, s: dict, end: int, row: int, after: int | None, termination: str = "entity_marker") -> None:
        """A record from the last boundary to ``end``; ``after`` is where its terminator line ends."""
        begin, first, base = s["next"], s["next_line"], self.carry.offset
        length = (after if after is not None else end) - begin
        index = self.carry.records + len(self.records)
        self._limit("record size bytes", length, self.limits.max_record_size)
        self._limit("records", index + 1, self.limits.max_records)
        last = max(row - 1, first)
        kind = fields = skip = places = entity = number = None
        odd = False
        if after is not None:
            lines = _split(self.data[begin:end])
            skip = next((i for i, x in enumerate(lines) if x.strip(BLANK)), None)
            if skip is not None and _TYPE.fullmatch(word := lines[skip].strip(BLANK)):
                kind, fields = word, lines[skip:]
                if not self.ascii and kind in TEXT_TYPES and not self.data[begin:end].isascii():
                    odd, places = True, self._places(first + skip, len(fields))
                if len(fields) > 1 and (entity := _unsigned(fields[1])) is not None:
                    number = self.entities
                    self.entities += 1
        self.records.append((
            index, s["section_index"], s["number"], s["part"], base + begin, length, first, row if after is not None else last, end - begin, last,
            base + end if after is not None else None, after - end if after is not None else None, first + skip if kind else None, termination, kind, fields, places, odd, entity, number,
        ))

    def _places(self, line: int, n: int) -> list[int]:
        """Offsets of n lines from the 1-based ``line`` on."""
        at = line - self.carry.line - 1
        return (self.starts[at : at + n] + self.carry.offset).tolist()

    def _close(self, s: dict, end: int, row: int, boundary: str) -> None:
        begin = s["next"]
        if begin < end and self.data[begin:end].strip(b" \t\n\f\r"):
            self._record(s, end, row, None, boundary)
            if s["number"] in FRAMED_SECTIONS:
                self.note("MI_UNTERMINATED_RECORD", f"section {s['number']} has data without a terminator", _span(self.carry.offset + begin, end - begin, s["next_line"], max(row - 1, s["next_line"])))
        self._piece(s, end, row)

    def _piece(self, s: dict, end: int, row: int | None) -> None:
        """What this stretch has of a section, up to ``end``; row: the line after it, if it ends here."""
        base, fields, places = self.carry.offset, None, None
        if s["number"] in FIELD_SECTIONS:
            fields = _split(self.data[s["body"] : end])
            places = self._places(int(np.searchsorted(self.starts, s["body"], "right")) + self.carry.line, len(fields))
        own = "at" in s
        self.sections.append({
            "section_index": s["section_index"], "number": s["number"], "part_index": s["part"], "at": base + s["at"] if own else None, "line": s["line"] if own else None,
            "marker_end": base + s["marker_end"] if own else None, "first_record": s["first_record"] if own else None, "end": base + end if row is not None else None, "row": row,
            "records_then": self.carry.records + len(self.records), "fields": fields, "field_at": places, "odd": fields is not None and not self.ascii and not all(map(str.isascii, fields)),
        })

    def record_columns(self, begin: int, end: int, seen: dict[int, int] | None) -> list[list]:
        """Columns of RECORD for some records; seen: the first entity index of each id so far, or None if it is told later."""
        part = self.records[begin:end]
        cols: list[list] = [list(c) for c in zip(*part, strict=True)]
        first = [None if r[18] is None or seen is None else seen.setdefault(r[18], r[19]) for r in part]
        return [*cols, first]


def head_of(data: bytes) -> dict:
    """The format that the first line with content tells; the first 64 KiB count."""
    mark = BOM if data.startswith(BOM) else b""
    first = next((x for x in re.finditer(rb"[^\r\n]+", data[len(mark) : 65536]) if x[0].strip(b" \t\f")), None)
    found = re.fullmatch(rb"#~([0-9]+)", first[0].strip(b" \t\f")) if first else None
    if not found or int(found[1]) >= 1 << 32:
        raise InvalidDrawing("no section mark on the first line with content")
    return {"kind": "mi_text", "compression": None, "first_section": int(found[1]), "utf8_bom": bool(mark)}


def section_row(piece: dict) -> dict:
    """A section that lies in one stretch."""
    at, line, body, end, row = (piece[k] for k in ("at", "line", "marker_end", "end", "row"))
    last, size = max(row - 1, line), end - body
    return {
        "section_index": piece["section_index"], "number": piece["number"], "span": _span(at, end - at, line, last), "marker_span": _span(at, body - at, line, line),
        "body_span": _span(body, size, line + 1, last) if size else _span(body, 0, line, line), "first_record": piece["first_record"], "record_count": piece["records_then"] - piece["first_record"],
        "part_index": piece["part_index"], "fields": piece["fields"], "field_at": piece["field_at"], "odd": piece["odd"],
    }


def drawing_row(head: dict, envelope: str | None, container: int, size: int, counts: list[int], preamble: dict | None, terminator: dict | None) -> dict:
    end = terminator["offset"] + terminator["length"] if terminator else size
    return {
        "format": head | {"compression": envelope}, "container_size": container, "source_size": size, "termination": "file_marker" if terminator else "physical_eof", "end_offset": end, "trailing_bytes": size - end,
        "preamble_span": preamble or _span(0, 0, 1, 1), "file_terminator_span": terminator, "newlines": dict(zip(("lf", "crlf", "cr", "unterminated"), counts, strict=True)), "line_count": sum(counts), "error": None,
    }


def whole_notes(row: dict) -> list[dict]:
    """Remarks on a drawing as a whole."""
    out, size, lines = [], row["source_size"], row["line_count"]

    def note(seq: int, code: str, message: str, span: dict) -> None:
        out.append({"phase": 0, "ordinal": 0, "seq": seq, "severity": "warning", "code": code, "message": message, "span": span})

    if sum(row["newlines"][k] > 0 for k in ("lf", "crlf", "cr")) > 1:
        note(0, "MI_MIXED_LINE_ENDINGS", "lines end in more than one way", _span(0, size, 1, max(1, lines)))
    if row["termination"] == "physical_eof":
        note(2 * size + 2, "MI_MISSING_FILE_TERMINATOR", "the stream ends without its end mark", _span(size, 0, max(1, lines), max(1, lines)))
    elif row["trailing_bytes"]:
        line = row["file_terminator_span"]["end_line"] + 1
        note(2 * size + 2, "MI_TRAILING_DATA", f"{row['trailing_bytes']} bytes follow the end mark", _span(row["end_offset"], row["trailing_bytes"], line, max(line, lines)))
    return out


def check_totals(limits: Limits, **totals: int) -> None:
    """Raise for the first total over its limit."""
    for name, what, most in (("size", "decompressed bytes", limits.max_decompressed_size), ("lines", "lines", limits.max_lines), ("widest", "line length bytes", limits.max_line_length), ("largest", "record size bytes", limits.max_record_size), ("sections", "sections", limits.max_sections), ("records", "records", limits.max_records)):
        if totals.get(name, 0) > most:
            raise LimitExceeded(f"{what}: {totals[name]} over {most}")


def _sparse(schema: pa.Schema, n: int, have: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(have[f.name], f.type) if f.name in have else pa.nulls(n, f.type) for f in schema], schema=schema)


def drawing_bytes(data: bytes | None, size: int, limits: Limits) -> tuple[bytes, str | None, dict]:
    """The logical bytes, the envelope and the format."""
    if data is None:
        if size is not None and size > limits.max_file_size:
            raise LimitExceeded(f"input bytes: {size} over {limits.max_file_size}")
        raise InvalidDrawing("no content")
    logical, envelope = unwrap(data, limits)
    check_totals(limits, size=len(logical))
    try:
        return logical, envelope, head_of(logical)
    except InvalidDrawing as bad:
        if envelope:
            raise InvalidDrawing(f"the {envelope} payload is no drawing") from bad
        raise


class Gathered:
    """Rows of SCAN_SCHEMA of drawings one after another, as batches of one row kind: to make a batch costs more than to frame a small drawing."""

    def __init__(self):
        self.schema, self.names = to_arrow_schema(SCAN_SCHEMA), [f.name for f in RECORD]
        self._begin()

    def _begin(self) -> None:
        self.own: dict[str, tuple[list[str], list[dict]]] = {kind: ([], []) for kind in ("drawing", "section", "diagnostic", "range")}
        self.who: list[str] = []
        self.records: list[list] = [[] for _ in RECORD]
        self.size = 0

    def one(self, kind: str, who: str, rows: list[dict]) -> None:
        keys, values = self.own[kind]
        keys += [who] * len(rows)
        values += rows

    def add(self, who: str, frame: Frame, sections: list[dict], seen: dict[int, int] | None, head: tuple[dict, list[dict]] | None) -> Iterator[pa.RecordBatch]:
        """A stretch, and the batches that are full then; head: the drawing's row and remarks, with its first stretch."""
        if head is not None:
            self.one("drawing", who, [head[0]])
            self.one("diagnostic", who, head[1])
        self.one("diagnostic", who, frame.diagnostics)
        self.one("section", who, sections)
        for i in range(0, len(frame.records), RECORDS_A_BATCH):
            cols = frame.record_columns(i, i + RECORDS_A_BATCH, seen)
            if len(self.who) + len(cols[0]) > RECORDS_A_BATCH:
                yield from self.rest()
            self.who += [who] * len(cols[0])
            for have, more in zip(self.records, cols, strict=True):
                have += more
        yield from self.full(len(frame.data))

    def full(self, more: int) -> Iterator[pa.RecordBatch]:
        """The batches, once they hold many rows, or rows of many bytes."""
        self.size += more
        if self.size >= BYTES_A_BATCH or len(self.who) + sum(len(keys) for keys, _ in self.own.values()) >= RECORDS_A_BATCH:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        own, who, records = self.own, self.who, self.records
        self._begin()
        for kind, (keys, rows) in own.items():
            if keys:
                yield _sparse(self.schema, len(keys), {"drawing_id": keys, "row": [kind] * len(keys), kind: rows})
        if who:
            yield _sparse(self.schema, len(who), {"drawing_id": who, "row": ["record"] * len(who)} | dict(zip(self.names, records, strict=True)))


def failed(size: int, bad: DrawingError) -> dict:
    """The row of a drawing that cannot be read."""
    return {f.name: None for f in DRAWING} | {"container_size": size, "error": {"class": type(bad).__name__, "message": str(bad)}}


def error_row(who: str, size: int, bad: DrawingError) -> pa.RecordBatch:
    return _sparse(to_arrow_schema(SCAN_SCHEMA), 1, {"drawing_id": [who], "row": ["drawing"], "drawing": [failed(size, bad)]})


def scan(df: DataFrame, limits: Limits, failfast: bool, range_size: int = RANGE) -> DataFrame:
    """Rows of SCAN_SCHEMA for drawings (drawing_id, content, size). A drawing that fails has its error, or raises; one of more than ``range_size`` bytes has its ranges."""

    def one(out: Gathered, who: str, data: bytes | None, size: int) -> Iterator[pa.RecordBatch]:
        try:
            logical, envelope, head = drawing_bytes(data, size, limits)
            if len(logical) > range_size:
                for part, (a, b) in enumerate(cuts(logical, range_size)):
                    out.one("range", who, [{"part": part, "content": logical[a:b], "container_size": len(data), "compression": envelope}])
                    yield from out.full(b - a)
                return
            frame = Frame(logical, limits)
            check_totals(limits, lines=len(frame.starts), widest=frame.widest, sections=len(frame.sections))
        except DrawingError as bad:
            if failfast:
                raise
            out.one("drawing", who, [failed(size, bad)])
            yield from out.full(0)
            return
        row = drawing_row(head, envelope, len(data), len(logical), frame.counts, frame.preamble, frame.terminator)
        yield from out.add(who, frame, [section_row(p) for p in frame.sections], {}, (row, whole_notes(row)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Gathered()
        for batch in batches:
            for who, data, size in zip(*[batch.column(c) for c in ("drawing_id", "content", "size")], strict=True):
                yield from one(out, who.as_py(), data.as_py(), size.as_py())
        yield from out.rest()

    return df.select("drawing_id", "content", "size").mapInArrow(run, SCAN_SCHEMA)


def line_rows(who: str, frame: Frame) -> Iterator[pa.RecordBatch]:
    """LINE_SCHEMA batches of a stretch."""
    schema, carry = to_arrow_schema(LINE_SCHEMA), frame.carry
    starts, ends = frame.starts, frame.ends
    content = ends - np.array([1, 2, 1, 0])[frame.kinds]
    n = len(starts)
    kinds = ["data"] * n
    # Marks after the end of the drawing are told as such too.
    for m in _MARK.finditer(frame.data):
        if carry.offset and m[0].startswith(BOM):
            continue
        i = int(np.searchsorted(starts, m.start(1), "right")) - 1
        if m[2] is None:
            kinds[i] = "entity_terminator" if m[1] == b"|~" else "file_terminator"
        elif int(m[2]) < 1 << 32:
            kinds[i] = "section_marker"
    numbers = np.full(n, -1, np.int64)
    for s in frame.sections:
        a = 0 if s["line"] is None else s["line"] - 1 - carry.line
        b = n if s["row"] is None else max(s["row"] - 1 - carry.line, a + 1)
        numbers[a:b] = s["number"]
    raw = [frame.data[a:b] for a, b in zip(starts.tolist(), content.tolist(), strict=True)]
    for i, x in enumerate(raw):
        if kinds[i] == "data" and not (x[3:] if i == 0 and carry.offset == 0 and x.startswith(BOM) else x).strip(b" \t\f"):
            kinds[i] = "blank"
    for a in range(0, n, 5 * RECORDS_A_BATCH):
        b = min(n, a + 5 * RECORDS_A_BATCH)
        yield _sparse(schema, b - a, {
            "drawing_id": [who] * (b - a), "number": list(range(carry.line + a + 1, carry.line + b + 1)), "offset": starts[a:b] + carry.offset, "length": (ends - starts)[a:b], "content_length": (content - starts)[a:b],
            "ending": _ENDINGS[frame.kinds[a:b]].tolist(), "kind": kinds[a:b], "section_number": [k if k >= 0 else None for k in numbers[a:b].tolist()], "content": raw[a:b],
        })


def lines(df: DataFrame, limits: Limits, range_size: int = RANGE) -> DataFrame:
    """Every physical line of the drawings that can be read and are no larger than a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for who, data, size in zip(*[batch.column(c) for c in ("drawing_id", "content", "size")], strict=True):
                try:
                    logical, _, _ = drawing_bytes(data.as_py(), size.as_py(), limits)
                    if len(logical) > range_size:
                        continue
                    frame = Frame(logical, limits)
                    check_totals(limits, lines=len(frame.starts), widest=frame.widest, sections=len(frame.sections))
                except DrawingError:
                    continue
                yield from line_rows(who.as_py(), frame)

    return df.select("drawing_id", "content", "size").mapInArrow(run, LINE_SCHEMA)
