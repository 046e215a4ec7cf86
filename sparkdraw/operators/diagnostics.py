"""Everything odd about a drawing, as rows in a fixed order: (phase, ordinal, seq).

Phases: 0 framing, 1 encoding, 2 global section, 3 contents, 4 parts, 5 records, 6 duplicate ids,
7 assemblies, 8 references, 9 the declared last id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strict import finite, trimmed, unsigned, whole
from .resolve import KEY, LATE
from .structure import unresolved_instances

COLUMNS = [KEY, "phase", "ordinal", "seq", "severity", "code", "message", "span"]
#: Fields that a global section should have, and the version whose layout is verified.
GLOBAL_FIELDS, VERIFIED = 45, "2.10"


def _rows(df: DataFrame, phase: int, ordinal, seq, severity: str, code, message: Column, span) -> DataFrame:
    as_col = lambda v: F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)
    code = code if isinstance(code, Column) else F.lit(code)
    return df.select(KEY, F.lit(phase).alias("phase"), as_col(ordinal).cast("bigint").alias("ordinal"), as_col(seq).cast("bigint").alias("seq"), F.lit(severity).alias("severity"), code.alias("code"), message.alias("message"), as_col(span).alias("span"))


def global_section(sections: DataFrame) -> DataFrame:
    """The first section 3 of each drawing, with its readings."""
    f = F.col("fields")
    at = lambda i: F.get(f, F.lit(i))
    ascii_ = lambda i: trimmed(at(i))
    text = lambda i: F.get("texts", F.lit(i))
    extents = F.transform(F.slice(f, 14, 4), finite)
    matrix = F.transform(F.slice(f, 30, 16), finite)
    good = lambda a, n: (F.size(a) == n) & whole(a)
    side = lambda i: F.get(extents, F.lit(i))
    box = F.when(
        good(extents, 4),
        F.struct(side(0).alias("xmin"), side(1).alias("xmax"), side(2).alias("ymin"), side(3).alias("ymax"), (side(1) - side(0)).alias("width"), (side(3) - side(2)).alias("height")),
    )
    first = sections.where("number = 3").withColumn("n__", F.row_number().over(Window.partitionBy(KEY).orderBy("section_index"))).where("n__ = 1")
    return first.select(
        KEY, "section_index", "body_span", F.size(f).alias("field_count"), text(0).alias("drawing_name"), text(7).alias("creation_date"), text(8).alias("creation_time"), text(10).alias("producer"),
        ascii_(11).alias("version"), ascii_(12).alias("dimension"), box.alias("extents"), ascii_(20).alias("paper_size"), finite(at(21)).alias("drawing_scale"), ascii_(22).alias("unit"), ascii_(23).alias("angle_unit"),
        F.when(good(matrix, 16), matrix).alias("transform_values"),
    )


def declared_last(sections: DataFrame) -> DataFrame:
    """(drawing_id, entry, toc_last_entity, body_span) from the first section 2 that has a LAST entry."""
    first = sections.where("number = 2").withColumn("n__", F.row_number().over(Window.partitionBy(KEY).orderBy("section_index"))).where("n__ = 1")
    entry = F.get(F.filter(F.transform("fields", trimmed), lambda x: x.startswith("LAST:")), F.lit(0))
    return first.select(KEY, entry.alias("entry"), unsigned(F.substring(entry, 6, 1 << 30)).alias("toc_last_entity"), "body_span").where("entry is not null")


def groups(notes: DataFrame, drawings: DataFrame, sections: DataFrame, records: DataFrame, entities: DataFrame, names: DataFrame, bound: DataFrame | None, placed: DataFrame | None, references: DataFrame, last: DataFrame) -> list[DataFrame]:
    """All observations, in frames by what they are made from; bound and placed: none if there are no assemblies."""
    none = F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in (("offset", 0), ("length", 0), ("start_line", 1), ("end_line", 1))])
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    head = global_section(sections)
    toc = declared_last(sections)
    ids = toc.where("toc_last_entity is not null").join(last, KEY, "left")
    framing = [
        notes.select(*COLUMNS),
        _rows(drawings.where("error is null").join(head.select(KEY), KEY, "left_anti"), 2, 0, 0, "warning", "MI_MISSING_GLOBAL_SECTION", F.lit("there is no section 3"), none),
        _rows(head.where(F.col("field_count") < GLOBAL_FIELDS), 2, 0, 1, "warning", "MI_GLOBAL_RECORD_TOO_SHORT", text(F.col("field_count"), f" fields of {GLOBAL_FIELDS}"), "body_span"),
        _rows(head.where(F.col("version").isNotNull() & (F.col("version") != VERIFIED)), 2, 0, 2, "info", "MI_GLOBAL_LAYOUT_UNVERIFIED", text("layout is known for 2.10, not for ", F.col("version")), "body_span"),
        _rows(head.where("extents is null and field_count >= 17"), 2, 0, 3, "warning", "MI_INVALID_GLOBAL_FIELD", F.lit("extents are not finite numbers"), "body_span"),
        _rows(head.where(F.col("transform_values").isNull() & (F.col("field_count") >= GLOBAL_FIELDS)), 2, 0, 4, "warning", "MI_INVALID_GLOBAL_FIELD", F.lit("the transform is not made of finite numbers"), "body_span"),
        _rows(toc.where("toc_last_entity is null"), 3, 0, 0, "warning", "MI_INVALID_TOC_LAST", F.lit("LAST is not an id"), "body_span"),
        _rows(names.where("raw_name = ''"), 4, "part_index", 0, "warning", "MI_EMPTY_PART_NAME", F.lit("a part has no name"), "span"),
        _rows(
            sections.where("number in (61, 62, 63, 71, 72, 81, 82) and part_index is null and record_count > 0"), 4, "section_index", 1, "warning", "MI_ENTITY_SECTION_OUTSIDE_PART", text("section ", F.col("number"), " stands before any part"), "span"
        ),
    ]
    decoding = [
        _rows(
            records.where("record_type is not null and entity_id is null").withColumn("span", F.struct("offset", F.col("payload_length").alias("length"), "start_line", F.col("payload_end_line").alias("end_line"))),
            5, "record_index", 0, "warning", "MI_INVALID_ENTITY_ID", text(F.col("record_type"), " has no valid id"), "span",
        ),
        text_errors(entities),
        _rows(entities.where("not known_type"), 5, "record_index", LATE, "info", "MI_UNSUPPORTED_ENTITY", text(F.col("mi_type"), " ", F.col("entity_id"), " is kept undecoded"), "payload_span"),
        _rows(entities.where("known_type and kind = 'unsupported'"), 5, "record_index", LATE, "warning", "MI_INVALID_ENTITY_RECORD", text(F.col("mi_type"), " ", F.col("entity_id"), " does not fit a known layout"), "payload_span"),
        _rows(entities.where("not is_first"), 6, "entity_index", 0, "error", "MI_DUPLICATE_ENTITY_ID", text("id ", F.col("entity_id"), " was taken by entity ", F.col("first_index")), "payload_span"),
    ]
    tied = []
    if bound is not None:
        ties = entities.where("kind = 'assembly'").select(KEY, "entity_index", "entity_id", "payload_span").join(bound, [KEY, "entity_index"])
        tied = [
            _rows(ties.where("part_index is null"), 7, "entity_index", 0, "warning", "MI_UNBOUND_ASSEMBLY", text("assembly ", F.col("entity_id"), " defines no part"), "payload_span"),
            _rows(ties.where("part_index is not null and not by_name"), 7, "entity_index", 0, "warning", "MI_ASSEMBLY_PART_NAME_MISMATCH", text("assembly ", F.col("entity_id"), " and part ", F.col("part_index"), " only share their place"), "payload_span"),
            _rows(
                unresolved_instances(placed, entities), 7, F.col("entity_index") + (1 << 40), "instance_index", "warning", F.when(F.col("exists"), "MI_REFERENCE_TYPE_MISMATCH").otherwise("MI_DANGLING_ASSEMBLY_REFERENCE"),
                text("assembly ", F.col("owner_id"), " places ", F.col("assembly_id"), ", which is no bound assembly"), "payload_span",
            ),
        ]
    resolving = [
        _rows(
            references.where("status <> 'ok'"), 8, "entity_index", "pos", "warning",
            F.when(F.col("status") == "mismatch", "MI_REFERENCE_TYPE_MISMATCH").when(F.col("expected") == "point", "MI_DANGLING_POINT_REFERENCE").when(F.col("expected") == "property", "MI_DANGLING_PROPERTY_REFERENCE").otherwise("MI_DANGLING_ENTITY_REFERENCE"),
            text("entity ", F.col("entity_id"), ", ", F.col("role"), ": ", F.col("target"), " is ", F.coalesce("found", F.lit("missing"))), "payload_span",
        ),
        _rows(ids.where("max_entity_id is null or max_entity_id <> toc_last_entity"), 9, 0, 0, "warning", "MI_TOC_LAST_MISMATCH", text("LAST is ", F.col("toc_last_entity"), ", the largest id is ", F.coalesce(F.col("max_entity_id").cast("string"), F.lit("none"))), "body_span"),
    ]
    return [union(rows) for rows in (framing, decoding, tied, resolving) if rows]


def union(frames: list[DataFrame]) -> DataFrame:
    total = frames[0]
    for more in frames[1:]:
        total = total.unionByName(more)
    return total


def text_fields() -> Column:
    """Places of a decoded record's text fields, by kind; a record that does not decode has none that counts."""
    value = F.col("mi_type")
    size = F.size("fields")
    return (
        F.when(value == "ASSP", F.sequence(F.lit(3), F.greatest(size - 1, F.lit(3))))
        .when(value == "DTA", F.array(*map(F.lit, (3, 4, 5))))
        .when(value == "DTV", F.array(*map(F.lit, (6, 7))))
        .when(value == "ASSE", F.array(unsigned(F.get("fields", F.lit(2))).cast("int") + 3))
        .when(F.col("kind") == "dimension", F.array(unsigned(F.get("fields", F.lit(2))).cast("int") + 4 + _measure()))
        .when(F.col("kind") == "text", F.transform(F.sequence(F.lit(1), F.size("text.lines")), lambda j: size - 2 * j))
    )


def _measure() -> Column:
    from .decode import DIMENSIONS

    out = F.when(F.lit(False), 0)
    for name, layout in DIMENSIONS.items():
        out = out.when(F.col("mi_type") == name, layout[4])
    return out


def text_errors(entities: DataFrame) -> DataFrame:
    """Text fields that are not strict text, with the byte at which each fails."""
    bad = entities.where(F.size("bad_fields") > 0).select(KEY, "record_index", "mi_type", "type_line", text_fields().alias("wanted"), F.explode("bad_fields").alias("b"))
    hit = bad.where(F.array_contains("wanted", F.col("b.field").cast("int")))
    line = F.col("type_line") + F.col("b.field")
    span = F.struct(F.col("b.at").alias("offset"), F.col("b.length").alias("length"), line.alias("start_line"), line.alias("end_line"))
    return _rows(hit.withColumn("span", span), 5, "record_index", F.col("b.field"), "warning", "MI_TEXT_DECODE_ERROR", F.concat(F.col("mi_type"), F.lit(" field "), F.col("b.field").cast("string"), F.lit(" fails at byte "), F.col("b.offset").cast("string")), "span")
