"""Drawings as a data source: ``spark.read.format("drawings")`` and ``spark.readStream.format("drawings")``.

    sparkdraw.register(spark)
    spark.read.format("drawings").option("table", "records").load("/data").where("record_type = 'LIN'")

Tables are those of framing: drawings, sections, records, lines, diagnostics. Fields are strings of one character
a byte; decoded texts and entities come from ``sparkdraw.read``, which also frames large drawings by many tasks,
where here a drawing is framed by one task.

Equality and IN filters on plain columns are done by the source: those on drawing_id leave files unlisted for
reading, those on record_type keep a record from becoming a row. Spark offers filters only in sessions with
spark.sql.python.filterPushdown.enabled; in others ``register`` brings a source that leaves them to Spark.

Options: table; mode (PERMISSIVE: a drawing that fails has a row with its error in drawings, and none elsewhere;
FAILFAST raises); pathGlobFilter, on file names; partitionBytes, the bytes of files that a task gets; each of Limits
by its name; for streams progressLocation. Empty files are drawings that fail (Spark's own file sources, and so
``sparkdraw.read``, leave them out). Paths are local ones, or of a file system that pyarrow.fs opens.

A stream logs the files of each batch in progressLocation, a folder of its own that outlives it, before Spark
learns of the batch. A restarted stream reads the log, so a file is in one batch only, whatever its time of change;
a path that was read isn't read again. All files that are new make one batch.
"""

from __future__ import annotations

import fnmatch
import json
import os
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import DrawingError
from . import scan
from .limits import MIB, Limits

_who = T.StructField("drawing_id", T.StringType())
TABLES = {
    "drawings": T.StructType([_who, *scan.DRAWING.fields]), "sections": T.StructType([_who, *scan.SECTION.fields]), "records": T.StructType([_who, *scan.RECORD]),
    "lines": scan.LINE_SCHEMA, "diagnostics": T.StructType([_who, *scan.DIAGNOSTIC.fields]),
}
#: Bytes of files that a task gets, if options don't say.
PARTITION_BYTES = 128 * MIB


@dataclass(frozen=True)
class Found:
    """A file: its id (the path with its scheme) and size."""

    drawing_id: str
    size: int


@dataclass
class Share(InputPartition):
    """The files of one task."""

    files: list[Found]


def _system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    if "://" not in path or path.startswith("file:"):
        path = path.removeprefix("file:")
        return arrow_fs.LocalFileSystem(), os.path.abspath("/" + path.lstrip("/") if path.startswith("/") else path)
    return arrow_fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


class Settings:
    """Options, checked."""

    def __init__(self, options):
        self.table = options.get("table", "records")
        if self.table not in TABLES:
            raise ValueError(f"no such table: {self.table}; there are {', '.join(TABLES)}")
        self.mode = options.get("mode", "PERMISSIVE").upper()
        if self.mode not in ("PERMISSIVE", "FAILFAST"):
            raise ValueError("mode must be one of PERMISSIVE, FAILFAST")
        self.paths = sorted(set(json.loads(options["paths"]) if options.get("paths") else [options["path"]] if options.get("path") else []))
        if not self.paths:
            raise ValueError("load needs a path")
        self.glob, self.progress = options.get("pathGlobFilter"), options.get("progressLocation")
        self.share = int(options.get("partitionBytes", PARTITION_BYTES))
        if self.share < 1:
            raise ValueError("partitionBytes must be positive")
        self.limits = Limits(**{f.name: int(options[f.name]) for f in fields(Limits) if f.name in options})

    def files(self) -> list[Found]:
        """Every file once, in order of its id; hidden names are left out, as Spark's own sources do."""
        found = {}
        for path in self.paths:
            system, inner = _system(path)
            before = "file:" if isinstance(system, arrow_fs.LocalFileSystem) else path[: -len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"
            top = system.get_file_info(inner)
            if top.type == arrow_fs.FileType.NotFound:
                raise FileNotFoundError(path)
            infos = [top] if top.is_file else [x for x in system.get_file_info(arrow_fs.FileSelector(inner, recursive=True)) if x.is_file]
            for x in infos:
                below = [] if top.is_file else posixpath.relpath(x.path, inner).split("/")
                if not any(map(_hidden, below)) and (self.glob is None or fnmatch.fnmatchcase(x.base_name, self.glob)):
                    found[before + x.path] = x.size
        return [Found(*x) for x in sorted(found.items())]

    def shares(self, files: list[Found]) -> list[Share]:
        """Files dealt to tasks, in order; a task gets ``share`` bytes, or one file. A drawing counts for 4 KiB at least, as opening it takes its time."""
        out: list[Share] = []
        room = 0
        for f in files:
            cost = max(4096, min(f.size, self.limits.max_file_size))
            if not out or cost > room:
                out.append(Share([]))
                room = self.share
            out[-1].files.append(f)
            room -= cost
        return out

    def rows(self, file: Found, sieve: dict[str, list]) -> Iterator[pa.RecordBatch]:
        """Batches of the table from one file; sieve: values that columns must have."""
        schema = to_arrow_schema(TABLES[self.table])
        data = None
        if file.size <= self.limits.max_file_size:
            system, inner = _system(file.drawing_id)
            with system.open_input_stream(inner, compression=None) as stream:
                data = stream.read()
        size = file.size if data is None else len(data)
        try:
            logical, envelope, head = scan.drawing_bytes(data, size, self.limits)
            frame = scan.Frame(logical, self.limits)
            scan.check_totals(self.limits, lines=len(frame.starts), widest=frame.widest, sections=len(frame.sections))
        except DrawingError as bad:
            if self.mode == "FAILFAST":
                raise
            made = scan.error_row(file.drawing_id, size, bad)
            if self.table == "drawings":
                yield from _sifted([_unpacked(made, "drawing", schema)], sieve)
            return
        if self.table == "lines":
            yield from _sifted(scan.line_rows(file.drawing_id, frame), sieve)
        elif self.table == "records":
            yield from _sifted(_records(file.drawing_id, frame, schema, sieve.get("record_type")), sieve)
        else:
            row = scan.drawing_row(head, envelope, size, len(logical), frame.counts, frame.preamble, frame.terminator)
            have = {"drawings": lambda: [row], "sections": lambda: [scan.section_row(p) for p in frame.sections], "diagnostics": lambda: frame.diagnostics + scan.whole_notes(row)}[self.table]()
            yield from _sifted([pa.RecordBatch.from_pylist([{"drawing_id": file.drawing_id} | r for r in have], schema=schema)], sieve)


def _unpacked(batch: pa.RecordBatch, name: str, schema: pa.Schema) -> pa.RecordBatch:
    inner = batch.column(name)
    return pa.RecordBatch.from_arrays([batch.column("drawing_id"), *[inner.field(f.name) for f in list(schema)[1:]]], schema=schema)


def _records(who: str, frame: scan.Frame, schema: pa.Schema, types: list[str] | None) -> Iterator[pa.RecordBatch]:
    """Records of some types, or all; every id counts for what is first, also those of records that are left out."""
    seen: dict[int, int] = {}
    names = [f.name for f in scan.RECORD][:-1]
    kind, entity, index = (names.index(n) for n in ("record_type", "entity_id", "entity_index"))
    kept = []

    def batch() -> pa.RecordBatch:
        cols = dict(zip([*names, "first_index"], zip(*kept, strict=True), strict=True)) | {"drawing_id": [who] * len(kept)}
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)

    for r in frame.records:
        first = None if r[entity] is None else seen.setdefault(r[entity], r[index])
        if types is None or r[kind] in types:
            kept.append((*r, first))
            if len(kept) == scan.RECORDS_A_BATCH:
                yield batch()
                kept.clear()
    if kept:
        yield batch()


def _sifted(batches, sieve: dict[str, list]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, values in sieve.items():
            column = batch.column(name)
            batch = batch.filter(pc.is_in(column, value_set=pa.array(values, column.type)))
        if len(batch):
            yield batch


class DrawingReader(DataSourceReader):
    """A batch read without filters of its own."""

    def __init__(self, settings: Settings):
        self.settings = settings
        self.sieve: dict[str, list] = {}

    def partitions(self) -> list[Share]:
        wanted = self.sieve.get("drawing_id")
        files = self.settings.files()
        return self.settings.shares(files if wanted is None else [f for f in files if f.drawing_id in set(wanted)]) or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        for file in partition.files:
            yield from self.settings.rows(file, self.sieve)


class SiftingReader(DrawingReader):
    """A batch read that takes equality and IN filters on strings and whole numbers; what it takes, Spark doesn't check again."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        types = {f.name: {T.StringType(): str, T.LongType(): int}.get(f.dataType) for f in TABLES[self.settings.table]}
        rest = []
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            name = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            # A null among the values makes no row pass.
            values = [v for v in values or () if v is not None]
            if name is None or types.get(name) is None or not all(type(v) is types[name] for v in values):
                rest.append(f)
            else:
                self.sieve[name] = values if name not in self.sieve else [v for v in self.sieve[name] if v in values]
        for f in rest:
            # An equal value is no null.
            if not (isinstance(f, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in self.sieve):
                yield f


class DrawingStream(DataSourceStreamReader):
    """Batches of new files, by a log of which batch has which."""

    def __init__(self, settings: Settings):
        if not settings.progress:
            raise ValueError("a stream needs the option progressLocation")
        self.settings = settings
        self._known: set[str] | None = None
        self._last = 0

    def __getstate__(self) -> dict:
        """Tasks get no log."""
        return self.__dict__ | {"_known": None}

    def _entry(self, number: int) -> list[Found]:
        system, inner = _system(self.settings.progress)
        with system.open_input_stream(f"{inner}/{number}.json", compression=None) as stream:
            return [Found(*x) for x in json.loads(stream.read())]

    def _load(self) -> None:
        system, inner = _system(self.settings.progress)
        system.create_dir(inner, recursive=True)
        numbers = sorted(int(x.base_name.removesuffix(".json")) for x in system.get_file_info(arrow_fs.FileSelector(inner)) if x.base_name.removesuffix(".json").isdecimal())
        self._known = {f.drawing_id for n in numbers for f in self._entry(n)}
        self._last = numbers[-1] if numbers else 0

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        if self._known is None:
            self._load()
        new = [f for f in self.settings.files() if f.drawing_id not in self._known]
        if new:
            # Written aside and then moved: an entry is there whole or not at all.
            system, inner = _system(self.settings.progress)
            number = self._last + 1
            with system.open_output_stream(f"{inner}/.{number}", compression=None) as stream:
                stream.write(json.dumps([[f.drawing_id, f.size] for f in new]).encode())
            system.move(f"{inner}/.{number}", f"{inner}/{number}.json")
            self._last = number
            self._known.update(f.drawing_id for f in new)
        return {"batch": self._last}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return self.settings.shares([f for n in range(start["batch"] + 1, end["batch"] + 1) for f in self._entry(n)])

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        for file in partition.files:
            yield from self.settings.rows(file, {})


class DrawingSource(DataSource):
    """The source of sessions that offer no filters to Python sources."""

    READER = DrawingReader

    @classmethod
    def name(cls) -> str:
        return "drawings"

    def schema(self) -> T.StructType:
        return TABLES[Settings(self.options).table]

    def _settings(self, schema: T.StructType) -> Settings:
        settings = Settings(self.options)
        if schema.fieldNames() != TABLES[settings.table].fieldNames():
            raise ValueError(f"the schema of {settings.table} is given; select columns after load")
        return settings

    def reader(self, schema: T.StructType) -> DrawingReader:
        return self.READER(self._settings(schema))

    def streamReader(self, schema: T.StructType) -> DrawingStream:
        return DrawingStream(self._settings(schema))


class SiftingSource(DrawingSource):
    """The source of sessions that offer filters."""

    READER = SiftingReader


def register(spark: SparkSession) -> None:
    """Make the format "drawings" known to the session. To change spark.sql.python.filterPushdown.enabled later, register again."""
    pushing = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower() == "true"
    spark.dataSource.register(SiftingSource if pushing else DrawingSource)
