"""The public face: a corpus of drawings as lazily built tables."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import CLASSES
from .functions import text as codecs
from .functions.geometry import apply
from .operators import audit, decode, diagnostics, polylines, query, raster, resolve, structure
from .operators import encoding as encodings
from .operators.polylines import CURVE_SEGMENTS
from .operators.resolve import KEY
from .sources import files, ranges, scan
from .sources.limits import Limits
from .storage import Shelf

MODES = ("PERMISSIVE", "FAILFAST")


class Corpus:
    """Tables of all drawings of one input; every table has ``drawing_id``.

    Framing, decoded entities and assembly bindings are written to the shared folder on first use, as
    most tables derive from them; ``close`` deletes what was written.
    """

    def __init__(self, source: DataFrame, limits: Limits, encoding: str | None, mode: str, range_size: int = scan.RANGE):
        self.source, self.limits, self.encoding, self.mode, self.range_size = source, limits, encoding, mode, range_size
        self.pieces = None
        self._shelf = Shelf()
        self._typed: dict[tuple[str, ...], DataFrame] = {}

    def close(self) -> None:
        self._shelf.clear()

    # Raw structure

    @cached_property
    def _framed(self) -> tuple[DataFrame, DataFrame | None, bool]:
        """Rows of all drawings, the ranges of large ones, and whether a text is not ASCII."""
        failfast, keep = self.mode == "FAILFAST", self._shelf.put
        rows, ready, large, odd = None, None, None, True
        if self.pieces is None:
            seen = Observation()
            some = lambda name, what: F.coalesce(F.bool_or(what), F.lit(False)).alias(name)
            made = scan.scan(self.source, self.limits, failfast, self.range_size).observe(seen, some("large", F.col("row") == "range"), some("odd", F.coalesce("odd", "section.odd", F.lit(False))))
            rows = keep(made, "scan")
            odd = seen.get["odd"] or seen.get["large"]
            if seen.get["large"]:
                large = rows.where("row = 'range'").select(KEY, "range.*")
                rows = rows.where("row <> 'range'")
        else:
            large = keep(ranges.aligned(self.pieces, keep).withColumns({"container_size": F.lit(None).cast("bigint"), "compression": F.lit(None).cast("string")}), "ranges")
        if large is not None:
            more, ready = ranges.scan(large, self.limits, failfast, keep)
            more = keep(more, "scan")
            rows = more if rows is None else rows.unionByName(more)
        return rows, ready, odd

    @cached_property
    def scan(self) -> DataFrame:
        """Framing: rows of drawings, sections, records and diagnostics."""
        return self._framed[0]

    @cached_property
    def _framed_drawings(self) -> DataFrame:
        return self.scan.where("row = 'drawing'").select(KEY, "drawing.*")

    @cached_property
    def _framed_sections(self) -> DataFrame:
        return self.scan.where("row = 'section'").select(KEY, "section.*")

    @cached_property
    def _framed_records(self) -> DataFrame:
        return self.scan.where("row = 'record'").select(KEY, *[f.name for f in scan.RECORD])

    @cached_property
    def encodings(self) -> DataFrame:
        """(drawing_id, name, source, declared_name, code, span, conflicts): how each drawing's texts are to be read, and why."""
        found = encodings.settle(self._framed_drawings, self._framed_sections, self._framed_records, self.encoding, self._framed[2])
        return self._shelf.put(found, "encodings")

    @cached_property
    def _drawings(self) -> DataFrame:
        return self._framed_drawings.join(self.encodings.select(KEY, F.struct("name", "source", "declared_name").alias("encoding")), KEY, "left")

    @cached_property
    def errors(self) -> DataFrame:
        return self._framed_drawings.where("error is not null").select(KEY, "error.class", "error.message")

    @cached_property
    def lines(self) -> DataFrame:
        ready = self._framed[1]
        rows = scan.lines(self.source, self.limits, self.range_size) if self.pieces is None else None
        large = ranges.lines(ready, self.limits) if ready is not None else None
        return rows if large is None else large if rows is None else rows.unionByName(large)

    def _texts(self, rows: DataFrame, wanted, name: str) -> DataFrame:
        """rows with ``texts`` and ``bad_fields``: ASCII as it is, where ``wanted``; other rows are decoded once the encoding is known."""
        none = F.lit(None).cast(encodings.BAD)
        plain = rows.withColumns({"texts": F.when(wanted, F.col("fields")), "bad_fields": F.when(wanted, F.slice(F.array(F.lit(None).cast(encodings.BAD.elementType)), 1, 0)).otherwise(none)})
        if not self._framed[2]:
            return plain
        return plain.where("not odd").unionByName(self._shelf.put(encodings.decoded(rows.where("odd"), self.encodings), name))

    @cached_property
    def sections(self) -> DataFrame:
        return self._texts(self._framed_sections, F.col("fields").isNotNull(), "sections")

    @cached_property
    def records(self) -> DataFrame:
        return self._texts(self._framed_records, F.col("record_type").isin(*scan.TEXT_TYPES), "texts")

    @cached_property
    def notes(self) -> DataFrame:
        """Diagnostics of framing, encodings and texts of sections."""
        framing = self.scan.where("row = 'diagnostic'").select(KEY, "diagnostic.*")
        found = framing.unionByName(encodings.notes(self.encodings))
        return found.unionByName(encodings.section_errors(self.sections)) if self._framed[2] else found

    def find_sections(self, number: int) -> DataFrame:
        return self.sections.where(F.col("number") == number)

    def records_of_type(self, record_type: str) -> DataFrame:
        return self.records.where(F.col("record_type") == record_type)

    @cached_property
    def logical(self) -> DataFrame:
        """(drawing_id, source): the logical bytes; only drawings in an envelope go through Python."""
        limits = self.limits

        def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for who, data in zip(*[batch.column(c) for c in (KEY, "content")], strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([who.as_py()]), pa.array([files.opened(data.as_py(), limits)], pa.binary())], names=[KEY, "source"])

        wrapped = files.compression(F.col("content")).isNotNull()
        plain = self.source.where(~F.coalesce(wrapped, F.lit(False))).select(KEY, F.col("content").alias("source"))
        return plain.unionByName(self.source.where(wrapped).select(KEY, "content").mapInArrow(opened, f"{KEY} string, source binary"))

    def slices(self, spans: DataFrame, offset: str = "offset", length: str = "length") -> DataFrame:
        """spans (drawing_id, offset, length, ...) with ``bytes``, cut from the logical streams; a drawing is opened once for all its spans."""
        limits, names = self.limits, [c for c in spans.columns if c != KEY]
        schema = T.StructType([spans.schema[KEY], *[spans.schema[c] for c in names], T.StructField("bytes", T.BinaryType())])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    data = files.opened(batch.column("content")[i].as_py(), limits)
                    rows = batch.column("spans__")[i].values
                    at, size = (rows.field(c).to_pylist() for c in (offset, length))
                    got = [data[a : a + n] if None not in (data, a, n) else None for a, n in zip(at, size, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(KEY)[i].as_py()] * len(rows)), *[rows.field(c) for c in names], pa.array(got, pa.binary())], names=[KEY, *names, "bytes"])

        packed = spans.groupBy(KEY).agg(F.collect_list(F.struct(*names)).alias("spans__"))
        return packed.join(self.source.select(KEY, "content"), KEY).mapInArrow(cut, schema)

    def inspect(self, records: bool = False, lines: bool = False) -> DataFrame:
        """(drawing_id, report): a JSON text a drawing, as the command line prints it; executors can write it."""
        sides = {"diagnostics": self.notes.select(KEY, F.struct("phase", "ordinal", "seq", "severity", "code", "message", "span").alias("v"))}
        if records:
            sides["records"] = self.records.select(KEY, F.struct(F.col("record_index").alias("index"), F.col("section_number").alias("section"), F.col("record_type").alias("type"), "offset", "length", "termination").alias("v"))
        if lines:
            sides["lines"] = self.lines.select(KEY, F.struct("number", "offset", "length", "ending", "kind", F.col("section_number").alias("section")).alias("v"))
        out = self.summary()
        for name, rows in sides.items():
            none = F.array().cast(T.ArrayType(rows.schema["v"].dataType))
            out = out.join(rows.groupBy(KEY).agg(F.array_sort(F.collect_list("v")).alias(name)), KEY, "left").withColumn(name, F.coalesce(name, none))
        return out.select(KEY, F.to_json(F.struct(*out.columns)).alias("report"), F.col("error").isNotNull().alias("failed"))

    def summary(self) -> DataFrame:
        """One row a drawing: format, sizes, newlines, and counts of lines, sections, records and record types."""
        types = self.records.where("record_type is not null").groupBy(KEY, "record_type").count()
        types = types.groupBy(KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("record_type", "count")))).alias("record_types"))
        counts = self.records.groupBy(KEY).agg(F.count("*").alias("record_count"))
        parts = self.sections.groupBy(KEY).agg(F.count("*").alias("section_count"), F.array_sort(F.collect_list(F.struct("section_index", "number", "span.offset", "span.length", "record_count"))).alias("sections"))
        out = self._drawings.drop("encoding")
        for side in (counts, parts, types):
            out = out.join(side, KEY, "left")
        return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("record_count", "section_count")})

    # Entities

    @cached_property
    def entities(self) -> DataFrame:
        return self._shelf.put(decode.decode(self.records, self._present), "entities")

    @cached_property
    def _present(self) -> set[str]:
        return decode.present_types(self._framed_records)

    def _of(self, *kinds: str) -> DataFrame:
        """Entities of some kinds, decoded from their own record types only and written out once, as readings of a record are used many times."""
        if "entities" in self.__dict__:
            return self.entities.where(F.col("kind").isin(*kinds))
        types = {t for k in kinds for t in decode.KINDS[k]}
        if kinds not in self._typed:
            plain = not types & scan.TEXT_TYPES
            rows = self._framed_records.withColumns({"texts": F.lit(None).cast("array<string>"), "bad_fields": F.lit(None).cast(encodings.BAD)}) if plain else self.records
            rows = decode.decode(rows.where(F.col("record_type").isin(*types)), types, sparse=True)
            # A point has two plain readings: to make them again costs less than to write them. Others are chosen by
            # kind only once they are written, as a filter moved below the readings would make them all twice.
            self._typed[kinds] = rows if kinds == ("point",) else self._shelf.put(rows, "entities")
        return self._typed[kinds].where(F.col("kind").isin(*kinds))

    def _has(self, kind: str) -> bool:
        return bool(self._present & set(decode.KINDS[kind]))

    @cached_property
    def located(self) -> DataFrame:
        return resolve.points(self._of("point"))

    @cached_property
    def points(self) -> DataFrame:
        return self._of("point").select(KEY, "entity_index", "entity_id", "part_index", "is_first", "point.x", "point.y")

    @cached_property
    def lines_geo(self) -> DataFrame:
        return resolve.lines_geo(self._of("line"), self.located)

    @cached_property
    def arcs(self) -> DataFrame:
        return resolve.arcs(self._of("arc", "fillet"), self.located)

    @cached_property
    def circles(self) -> DataFrame:
        return resolve.circles(self._of("circle"), self.located)

    @cached_property
    def bsplines(self) -> DataFrame:
        return resolve.bsplines(self._of("bspline"), self.located)

    @cached_property
    def hatches(self) -> DataFrame:
        return resolve.hatches(self._of("hatch", "hatch_assoc"))

    @cached_property
    def dimensions(self) -> DataFrame:
        return resolve.dimensions(self._of("dimension", "tolerance"))

    @cached_property
    def hatch_patterns(self) -> DataFrame:
        return resolve.hatch_patterns(self._of("hatch", "hatch_assoc", "property"))

    @cached_property
    def hatch_contours(self) -> DataFrame:
        """Hatches with their boundary loops as contours, null where there is none, and with their pattern."""
        contours = self._of("contour").where("is_first").select(KEY, "entity_id", F.struct("entity_id", "contour.closed", "contour.orientation", "contour.component_ids").alias("value"))
        rows = resolve.attached(self.hatches, "boundary_loop_ids", contours, "boundary_loops")
        return rows.join(self.hatch_patterns.select(KEY, "entity_index", "pattern"), [KEY, "entity_index"], "left")

    @cached_property
    def dimension_tolerances(self) -> DataFrame:
        """Dimensions with their tolerances as structs."""
        found = self._of("tolerance").where("is_first").select(KEY, "entity_id", F.struct("entity_id", "tolerance.*").alias("value"))
        return resolve.attached(self.dimensions, "tolerance_ids", found, "tolerances")

    def variant(self, kind: str) -> DataFrame:
        """Entities of a kind with its own columns: text, property, tolerance, leader, contour, hatch_assoc, symbol, assembly."""
        extra = [c for c in ("graphic",) if kind in ("text", "leader", "contour")]
        return self._of(kind).select(KEY, "entity_index", "entity_id", "mi_type", "part_index", *extra, f"{kind}.*")

    texts = cached_property(lambda self: self.variant("text"))
    properties = cached_property(lambda self: self.variant("property"))
    tolerances = cached_property(lambda self: self.variant("tolerance"))
    leaders = cached_property(lambda self: self.variant("leader"))
    contours = cached_property(lambda self: self.variant("contour"))
    hatch_assocs = cached_property(lambda self: self.variant("hatch_assoc"))
    symbols = cached_property(lambda self: self.variant("symbol"))
    assemblies = cached_property(lambda self: self.variant("assembly"))
    unsupported = cached_property(lambda self: self.entities.where("kind = 'unsupported'"))
    graphics = cached_property(lambda self: self.entities.where("is_graphic"))
    annotations = cached_property(lambda self: self.entities.where("is_annotation"))
    layers = cached_property(lambda self: resolve.layers(self.entities))
    references = cached_property(lambda self: resolve.references(self.entities, self._has("hatch")))
    attachments = cached_property(lambda self: resolve.attachments(self.entities))

    def get(self, entity_id: int) -> DataFrame:
        """What an id means in each drawing."""
        return self.entities.where((F.col("entity_id") == entity_id) & F.col("is_first"))

    # Structure

    @cached_property
    def part_names(self) -> DataFrame:
        return structure.part_names(self.sections)

    @cached_property
    def bound(self) -> DataFrame:
        return self._shelf.put(structure.bind(self._of("assembly"), self.part_names), "bound")

    @cached_property
    def instances(self) -> DataFrame:
        return self._shelf.put(structure.instances(self._of("assembly", "property"), self.bound), "instances")

    @cached_property
    def parts(self) -> DataFrame:
        return structure.parts(self.part_names, self.entities, self.bound, self.instances)

    @cached_property
    def roots(self) -> DataFrame:
        return structure.roots(self.parts)

    @cached_property
    def sheets(self) -> DataFrame:
        """Parts placed as sheets, once a placement, in source order."""
        return self.instances.where("is_sheet and parent_part_index is not null and target_part_index is not null").select(KEY, "entity_index", "instance_index", F.col("target_part_index").alias("part_index"))

    @cached_property
    def drawings(self) -> DataFrame:
        """One row a drawing, with its global section, declared last id and root parts."""
        head = diagnostics.global_section(self.sections)
        head = head.select(KEY, F.struct(*[c for c in head.columns if c not in (KEY, "body_span", "field_count")]).alias("global"))
        sheets = self.sheets.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("entity_index", "instance_index", "part_index"))), lambda v: v["part_index"]).alias("sheet_part_indices"))
        out = self._drawings
        for side in (head, diagnostics.declared_last(self.sections).select(KEY, "toc_last_entity"), self.roots, sheets):
            out = out.join(side, KEY, "left")
        return out

    def modelspace(self, names: str = "*") -> DataFrame:
        """Graphics of each drawing's top part, not expanded. With mode FAILFAST a drawing without a part raises once the plan runs."""
        top = self.roots.select(F.col(KEY).alias("k__"), F.col("top_part_index").alias("t__"))
        rows = self.query(names)
        found = rows.join(top, (rows[KEY] == top["k__"]) & (rows["part_index"] == top["t__"]), "left_semi")
        if self.mode != "FAILFAST":
            return found
        bare = self._framed_drawings.where("error is null").join(self.part_names.select(KEY), KEY, "left_anti")
        return found.unionByName(structure.refused(bare, F.concat(F.col(KEY), F.lit(" has no part")), found))

    def query(self, names: str = "*", part: int | None = None) -> DataFrame:
        return query.select(self.entities, names, query.GRAPHICS, "is_graphic", part)

    def query_annotations(self, names: str = "*", part: int | None = None) -> DataFrame:
        return query.select(self.entities, names, query.ANNOTATIONS, "is_annotation", part)

    def occurrences(self, root: DataFrame | None = None, include_root: bool = True, strict: bool = True) -> DataFrame:
        """Placed parts below each drawing's top part, or below ``root`` (drawing_id, part_index).

        Roots that are no part of their drawing raise once the plan runs, or are left out if not strict.
        """
        strangers = None
        if root is None:
            root = self.roots.select(KEY, F.col("top_part_index").alias("part_index"))
        else:
            asked, own = root.select(KEY, F.col("part_index").cast("long").alias("part_index")), self.part_names.select(KEY, "part_index")
            root = asked.join(own, [KEY, "part_index"], "left_semi")
            strangers = asked.join(own, [KEY, "part_index"], "left_anti") if strict else None
        found = structure.occurrences(self.instances, root, self._shelf.put, strict)
        if strangers is not None:
            found = found.unionByName(structure.refused(strangers, F.concat(F.lit("part "), F.col("part_index").cast("string"), F.lit(" is no part of "), F.col(KEY)), found))
        return found if include_root else found.where("depth > 0")

    def sheet_instances(self, strict: bool = True) -> DataFrame:
        return self.occurrences(include_root=False, strict=strict).where("is_sheet")

    def placed_graphics(self, root: DataFrame | None = None, strict: bool = True) -> DataFrame:
        """Each graphic once for every occurrence of its part."""
        at = self.occurrences(root, strict=strict).select(F.col(KEY).alias("k__"), F.col("part_index").alias("p__"), "depth", "path", "order_key", "world")
        g = self.graphics.select(KEY, "entity_index", "entity_id", "mi_type", "kind", "part_index", "graphic")
        return g.join(at, (g[KEY] == at["k__"]) & (g["part_index"] == at["p__"])).drop("k__", "p__")

    def placed_lines(self, strict: bool = True) -> DataFrame:
        """Lines with their ends in the top part's coordinates, once for every occurrence."""
        at = self.occurrences(strict=strict).select(F.col(KEY).alias("k__"), F.col("part_index").alias("p__"), "path", "world")
        g = self.lines_geo
        rows = g.join(at, (g[KEY] == at["k__"]) & (g["part_index"] == at["p__"])).drop("k__", "p__")
        return rows.withColumns({c: apply(F.col("world"), F.col(c)) for c in ("start", "end")})

    def polylines(self, segments: int = CURVE_SEGMENTS, expand: bool = False, strict: bool = True) -> DataFrame:
        """Vertices of lines, arcs, circles and splines; only kinds that occur are planned."""
        kinds = {"line": "lines_geo", "arc": "arcs", "circle": "circles", "bspline": "bsplines"}
        have = {k: self._has(k) or (k == "arc" and self._has("fillet")) for k in kinds}
        shapes = polylines.polylines(*[getattr(self, name) if have[k] else None for k, name in kinds.items()], segments=segments, spark=self.source.sparkSession)
        return polylines.placed(shapes, self.occurrences(strict=strict)) if expand else shapes

    def marks(self, expand: bool = False, strict: bool = True) -> DataFrame:
        """Points and decoded texts as a preview shows them."""
        rows = polylines.marks(self.points, self.texts)
        return polylines.placed_marks(rows, self.occurrences(strict=strict)) if expand else rows

    def skipped(self, segments: int = CURVE_SEGMENTS) -> DataFrame:
        return polylines.skipped(self.polylines(segments), self.texts)

    def previews(self, width: int = raster.WIDTH, height: int = raster.HEIGHT, segments: int = CURVE_SEGMENTS, expand: bool = False, strict: bool = True, points: bool = False, texts: bool = True, **look) -> DataFrame:
        """(drawing_id, width, height, png): an image a drawing, painted on the executors; a drawing that shows nothing has no row. Texts are strokes along their baselines; ``look`` is as in ``raster.painted``."""
        shown = self.marks(expand, strict).where(F.when(F.col("mi_type") == "P", points).otherwise(texts)) if points or texts else None
        strokes = raster.strokes(self.polylines(segments, expand, strict), shown)
        return raster.images(raster.painted(strokes, width=width, height=height, **look), width, height)

    def draw(self, path: str, drawing_id: str, segments: int = CURVE_SEGMENTS, expand: bool = False, strict: bool = True, points: bool = False, texts: bool = True, **look) -> None:
        """A PNG of one drawing; what it leaves out is summed up in a warning for each reason."""
        of = lambda df: df.where(F.col(KEY) == drawing_id)
        shown = of(self.marks(expand, strict)).where(F.when(F.col("mi_type") == "P", points).otherwise(texts)) if points or texts else None
        polylines.draw(of(self.polylines(segments, expand, strict)), path, shown, **look)
        for row in of(self.skipped(segments)).collect():
            more = row["count"] - len(row["entity_ids"])
            warnings.warn(f"{row['count']} left out, {row['reason']}: {', '.join(map(str, row['entity_ids']))}{f' and {more} more' if more else ''}", stacklevel=2)

    # Reports

    @cached_property
    def _observed(self) -> list[DataFrame]:
        """Diagnostics, in frames by what they are made from. Sections are read in many ways, so they are written apart from what is framed with them."""
        sections, tied = self._shelf.put(self.sections, "sections"), self._has("assembly")
        return diagnostics.groups(
            self.notes, self._framed_drawings, sections, self.records, self.entities, structure.part_names(sections), self.bound if tied else None, self.instances if tied else None, self.references, resolve.last_ids(self.entities)
        )

    @cached_property
    def diagnostics(self) -> DataFrame:
        return diagnostics.union(self._observed)

    def audit(self) -> DataFrame:
        hatched, measured = self._has("hatch") or self._has("hatch_assoc"), self._has("dimension")
        aimed = measured or self._has("contour") or self._has("symbol")
        return audit.audit(
            self._framed_records, self.entities, self.hatches if hatched else None, self.dimensions if measured else None, self._observed, self.references if aimed else None, self.layers, self.hatch_patterns if hatched else None, self._shelf.put
        )

    def audit_files(self) -> DataFrame:
        """The audit's row for each drawing that could be read."""
        version = diagnostics.global_section(self.sections).select(KEY, "version")
        return audit.by_file(self.source, self._drawings.join(version, KEY, "left"), self._framed_records, self.entities, self._observed, self._shelf.put)

    TABLES = (
        "drawings", "lines", "sections", "records", "entities", "points", "lines_geo", "arcs", "circles", "bsplines", "texts", "properties", "tolerances", "dimensions", "leaders", "contours", "hatches", "hatch_assocs", "symbols",
        "assemblies", "instances", "parts", "references", "attachments", "layers", "diagnostics", "errors",
    )

    def register_views(self, prefix: str = "") -> None:
        """Temporary views of all tables, for SQL."""
        for name in self.TABLES:
            getattr(self, name).createOrReplaceTempView(prefix + name)


def read(spark: SparkSession, source, limits: Limits | None = None, encoding: str | None = None, mode: str = "PERMISSIVE", glob: str | None = None, range_size: int = scan.RANGE) -> Corpus:
    """A corpus from paths, or from a DataFrame with drawing_id and content.

    With a column ``part`` the rows of a DataFrame are pieces of drawings, cut anywhere and ordered by it.
    Drawings of more than ``range_size`` bytes, and pieces, are framed in ranges by many tasks. Drawings that
    cannot be read have a row in ``errors``; with mode FAILFAST the first one raises.
    """
    limits = limits or Limits()
    name = None
    if encoding is not None and (name := codecs.encoding_of(encoding)) is None:
        raise ValueError(f"unsupported text encoding: {encoding}")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    pieces = None
    if isinstance(source, DataFrame):
        rows = source.select(F.col("drawing_id").cast("string").alias("drawing_id"), F.col("content").cast("binary").alias("content"), F.octet_length("content").cast("bigint").alias("size"), *(["part"] if "part" in source.columns else []))
        if "part" in source.columns:
            pieces = rows.withColumn("part", F.col("part").cast("bigint"))
            order = F.struct(F.col("part").alias("at"), "content")
            rows = pieces.groupBy("drawing_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["content"].cast("string")), "").cast("binary").alias("content")).withColumn("size", F.octet_length("content").cast("bigint"))
    else:
        rows = files.load(spark, source, limits, glob)
    out = Corpus(rows, limits, name, mode, range_size)
    out.pieces = pieces
    return out


__all__ = ["CLASSES", "Corpus", "Limits", "read"]
