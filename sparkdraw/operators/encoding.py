"""Text encodings of drawings, settled by aggregation, and strict texts of fields.

A drawing's encoding comes from the reader, a byte order mark, the version, a declaration, or the texts at
eight places: four fields of section 3, names of parts, two fields of TEX and the name of ASSE. Only rows of
these places that are not ASCII are looked at, each is tried alone, and flags are aggregated by drawing.
Fields are strings of one character a byte; those that are ASCII are texts as they are, and the few others
go through one Arrow pass once the encoding is known.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as codecs
from ..functions.strict import trimmed, unsigned

KEY = "drawing_id"
#: Places of texts in section 3 and in TEX records, and of the version.
HEAD_TEXTS, TEX_TEXTS, VERSION = (0, 7, 8, 10), (19, 28), 11
#: Beyond the number of sections of a drawing.
LATE = 1 << 40
BAD = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("field", "offset", "length", "at")]))


def raw(x: Column) -> Column:
    """The bytes of a string of one character a byte."""
    return F.encode(x, "ISO-8859-1")


@F.pandas_udf(T.BooleanType())
def _is_shift_jis(x: pd.Series) -> pd.Series:
    return x.map(lambda v: codecs.decodes(bytes(v), "shift_jis")).astype(bool)


def _span(offset: Column, length: Column, line: Column) -> Column:
    return F.struct(*[v.cast("bigint").alias(n) for n, v in (("offset", offset), ("length", length), ("start_line", line), ("end_line", line))])


def encoding_of(label: Column) -> Column:
    """The encoding that a label names, or null."""
    plain = F.lower(F.translate(label, "-_ ", ""))
    out = F.when(F.lit(False), F.lit(""))
    for name, labels in codecs.LABELS.items():
        out = out.when(plain.isin(*labels), F.lit(name))
    return out


def version_is_utf8(version: Column) -> Column:
    """3.20 and later, each part read as a number; 3.4 is earlier."""
    part = lambda i: F.get(F.split(trimmed(version), r"\."), F.lit(i))
    number = lambda i: F.when(part(i).rlike(r"^\+?[0-9]+$"), part(i).try_cast("decimal(38,0)"))
    return F.coalesce((number(0) > 3) | ((number(0) == 3) & (F.coalesce(number(1), F.lit(0)) >= 20)), F.lit(False))


def declarations(sections: DataFrame) -> DataFrame:
    """(drawing_id, at, label, span) of each ENCODING line of sections 1; ``at`` gives their order."""
    rows = sections.where("number = 1").select(KEY, "section_index", "field_at", F.col("body_span.start_line").alias("first"), F.posexplode("fields").alias("i", "x"))
    text, colon = trimmed(F.col("x")), F.instr("x", ":")
    hit = rows.where((colon > 0) & (F.upper(F.substring_index(text, ":", 1)) == "ENCODING"))
    label = F.make_valid_utf8(raw(trimmed(F.expr("substring(x, instr(x, ':') + 1)"))).cast("string"))
    return hit.select(KEY, F.struct("section_index", "i").alias("at"), label.alias("label"), _span(F.get("field_at", F.col("i")) + colon, F.length("x") - colon, F.col("first") + F.col("i")).alias("span"))


def candidates(sections: DataFrame, records: DataFrame) -> DataFrame:
    """(drawing_id, at, x, span) of what is not ASCII at the eight places; ``at`` gives their order."""

    def some(rows: DataFrame, group: int, index: str, line: Column, wanted: Column) -> DataFrame:
        picked = rows.select(KEY, F.col(index).alias("index"), line.alias("line"), "fields", "field_at", F.explode(wanted).alias("i"))
        at = F.struct(F.lit(group).alias("group"), "index", F.col("i").cast("bigint").alias("i"))
        out = picked.select(KEY, at.alias("at"), F.get("fields", F.col("i")).alias("x"), F.get("field_at", F.col("i")).alias("offset"), (F.col("line") + F.col("i")).alias("line"))
        return out.where(F.col("x").rlike(r"[^\x00-\x7F]"))

    body = F.col("body_span.start_line")
    odd = sections.where("odd")
    named = F.array_position(F.transform("fields", lambda x: trimmed(x) != ""), True).cast("int") - 1
    rows = some(odd.where("number = 3"), 0, "section_index", body, F.array(*map(F.lit, HEAD_TEXTS)))
    rows = rows.unionByName(some(odd.where("number = 6"), 0, "section_index", body, F.array(named)))
    strange = records.where("odd")
    rows = rows.unionByName(some(strange.where("record_type = 'TEX'"), 1, "record_index", F.col("type_line"), F.array(*map(F.lit, TEX_TEXTS))))
    count = unsigned(F.get("fields", F.lit(2)))
    rows = rows.unionByName(some(strange.where("record_type = 'ASSE'"), 1, "record_index", F.col("type_line"), F.array((3 + F.when(count <= F.size("fields"), count)).cast("int"))))
    return rows.select(KEY, "at", "x", _span(F.col("offset"), F.length("x"), F.col("line")).alias("span"))


def settle(drawings: DataFrame, sections: DataFrame, records: DataFrame, override: str | None, odd: bool = True) -> DataFrame:
    """(drawing_id, name, source, declared_name, code, span, conflicts): one row a drawing; odd: whether anything is not ASCII.

    code: what is to be said of the choice, or null; conflicts: further declarations of other labels.
    """
    said = declarations(sections)
    first = said.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("at", "label", "span"))).alias("said"))
    own = F.get("said", F.lit(0))
    others = F.filter("said", lambda s: F.upper(s["label"]) != F.upper(own["label"]))
    first = first.select(KEY, own["label"].alias("declared_name"), own["span"].alias("declared_span"), F.transform(others, lambda s: s["span"]).alias("conflicts"), F.transform(others, lambda s: s["label"]).alias("labels"))
    head = sections.where("number = 3").groupBy(KEY).agg(F.min_by(trimmed(F.get("fields", F.lit(VERSION))), "section_index").alias("version"))
    rows = drawings.where("error is null").select(KEY, F.col("format.utf8_bom").alias("bom")).join(first, KEY, "left").join(head, KEY, "left")
    if odd:
        tried = candidates(sections, records).select(KEY, "at", "span", "x", F.is_valid_utf8(raw(F.col("x")).cast("string")).alias("utf8"), _is_shift_jis(raw(F.col("x"))).alias("sjis"))
        pair = F.col("x").rlike("[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]")
        found = tried.groupBy(KEY).agg(F.bool_and("utf8").alias("utf8"), (F.bool_and("sjis") & F.bool_or(pair)).alias("sjis"), F.min_by("span", "at").alias("odd_span"))
        rows = rows.join(found, KEY, "left")
    else:
        rows = rows.withColumns({"utf8": F.lit(None).cast("boolean"), "sjis": F.lit(None).cast("boolean"), "odd_span": F.lit(None).cast(sections.schema["span"].dataType)})
    declared = encoding_of(F.col("declared_name"))
    cases = [
        (F.lit(override is not None), "override", F.lit(override).cast("string")), (F.col("bom"), "utf8_bom", F.lit("utf-8")), (version_is_utf8(F.col("version")), "mi_version", F.lit("utf-8")),
        (F.col("declared_name").isNotNull(), "declared", declared), (F.col("utf8").isNull(), "ascii_only", F.lit(None).cast("string")), (F.col("utf8"), "heuristic", F.lit("utf-8")), (F.col("sjis"), "heuristic", F.lit("shift_jis")),
    ]
    source, name = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for hit, origin, value in cases:
        source, name = source.when(hit, origin), name.when(hit, value)
    rows = rows.withColumns({"name": name, "source": source.otherwise("undetermined"), "declared": declared})
    code = (
        F.when(F.col("source").isin("override", "utf8_bom", "mi_version") & (F.col("declared") != F.col("name")), "MI_ENCODING_CONFLICT").when((F.col("source") == "declared") & F.col("name").isNull(), "MI_UNSUPPORTED_DECLARED_ENCODING")
        .when(F.col("source") == "heuristic", "MI_ENCODING_GUESSED").when(F.col("source") == "undetermined", "MI_ENCODING_UNDETERMINED")
    )
    span = F.when(F.col("declared_name").isNotNull(), F.col("declared_span")).otherwise(F.col("odd_span"))
    return rows.select(KEY, "name", "source", "declared_name", code.alias("code"), span.alias("span"), F.arrays_zip("conflicts", "labels").alias("conflicts"))


def notes(settled: DataFrame) -> DataFrame:
    """Diagnostics of phase 1: further declarations, then what is to be said of the choice."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("none")) for p in parts])
    row = lambda seq, severity, code, message, span: (F.lit(1).alias("phase"), F.lit(0).cast("bigint").alias("ordinal"), seq.cast("bigint").alias("seq"), severity.alias("severity"), code.alias("code"), message.alias("message"), span.alias("span"))
    other = settled.select(KEY, "declared_name", F.posexplode("conflicts").alias("i", "c"))
    other = other.select(KEY, *row(F.col("i"), F.lit("warning"), F.lit("MI_CONFLICTING_ENCODING_DECLARATION"), text(F.col("c.labels"), " after ", F.col("declared_name")), F.col("c.conflicts")))
    loud = F.when(F.col("code").isin("MI_UNSUPPORTED_DECLARED_ENCODING", "MI_ENCODING_UNDETERMINED"), "warning").otherwise("info")
    own = settled.where("code is not null").select(KEY, *row(F.lit(LATE), loud, F.col("code"), text("encoding ", F.col("name"), " from ", F.col("source"), ", declared ", F.col("declared_name")), F.col("span")))
    return other.unionByName(own)


def decoded(rows: DataFrame, settled: DataFrame) -> DataFrame:
    """rows (drawing_id, fields, field_at, ...) with ``texts`` and ``bad_fields``: strict texts, null where there is none, and where each fails.

    Places are told for known encodings only; ``at`` is the place in the stream, whatever the line ends are.
    """
    named = rows.join(settled.select(KEY, F.col("name").alias("name__")), KEY, "left")
    schema = T.StructType([*rows.schema, T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("bad_fields", BAD)])
    kept = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, bads = [], []
            for fields, places, name in zip(*[batch.column(c).to_pylist() for c in ("fields", "field_at", "name__")], strict=True):
                out, bad = [], []
                for i, x in enumerate(fields):
                    try:
                        out.append(x if x.isascii() else codecs.decode(x.encode("latin-1"), name))
                    except codecs.BadBytes as e:
                        out.append(None)
                        if name is not None:
                            bad.append({"field": i, "offset": e.offset, "length": e.length, "at": places[i] + e.offset})
                texts.append(out)
                bads.append(bad)
            made = [pa.array(texts, pa.list_(pa.string())), pa.array(bads, to_arrow_schema(schema).field("bad_fields").type)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], names=schema.names)

    return named.mapInArrow(run, schema)


def section_errors(sections: DataFrame) -> DataFrame:
    """Diagnostics of texts in the first section 3 and of names of parts that are not in the encoding."""
    rows = sections.where("number in (3, 6) and size(bad_fields) > 0")
    heads = sections.where("number = 3").groupBy(KEY).agg(F.min("section_index").alias("head__"))
    rows = rows.join(heads, KEY, "left").where("number = 6 or section_index = head__")
    named = F.array_position(F.transform("fields", lambda x: trimmed(x) != ""), True) - 1
    wanted = F.when(F.col("number") == 3, F.array(*[F.lit(i).cast("bigint") for i in HEAD_TEXTS])).otherwise(F.array(named))
    hit = rows.select(KEY, "number", "section_index", F.col("body_span.start_line").alias("first"), wanted.alias("wanted"), F.explode("bad_fields").alias("b")).where(F.array_contains("wanted", F.col("b.field")))
    message = F.concat(F.lit("field "), F.col("b.field").cast("string"), F.lit(" of section "), F.col("number").cast("string"), F.lit(" fails at byte "), F.col("b.offset").cast("string"))
    return hit.select(
        KEY, F.when(F.col("number") == 3, 2).otherwise(4).alias("phase"), F.col("section_index").alias("ordinal"), F.col("b.field").alias("seq"), F.lit("warning").alias("severity"), F.lit("MI_TEXT_DECODE_ERROR").alias("code"),
        message.alias("message"), _span(F.col("b.at"), F.col("b.length"), F.col("first") + F.col("b.field")).alias("span"),
    )
