"""Registered queries on framing, records, text, structure and shapes, one or a few operators each."""

from __future__ import annotations

import gzip
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import corpus
from ..functions import geometry as G
from ..operators import polylines, raster
from ..operators.decode import DIMENSIONS
from ..operators.resolve import KEY
from ..sources import reader
from ..sources.limits import Limits
from ..storage import shared_dir
from . import synth as S
from .common import many_drawings, query, read, table, zipped

c = F.col


def _union(frames: list[DataFrame]) -> DataFrame:
    total = frames[0]
    for more in frames[1:]:
        total = total.unionByName(more)
    return total


def _tally(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).agg(F.count("*").alias("n"))


# Framing


@query("""SELECT conv_id, count(*) AS data, 2 + count(*) FILTER (turn % 2 = 0) AS blank, count(*) FILTER (turn % 2 = 1) AS ends,
          CAST(12 + sum(length(CAST(turn AS VARCHAR)) + 8 + turn % 2) AS BIGINT) AS bytes, CAST(7 + sum(length(CAST(turn AS VARCHAR)) + 8 + turn % 2) AS BIGINT) AS last_offset
          FROM conversations GROUP BY conv_id""")
def q31_line_classes(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    after = F.when(c("turn") % 2 == 0, " \n").otherwise("|~\n")
    body = S.rows(t, c("conv_id"), 1, 1, c("turn"), F.lit("turn "), c("turn").cast("string"), F.lit("\n"), after)
    rows = read(spark, body, mark=b"\n \n").lines
    kind = lambda name: F.count(F.when(c("kind") == name, 1))
    found = rows.groupBy(c(KEY).cast("bigint").alias("conv_id")).agg(
        kind("data").alias("data"), kind("blank").alias("blank"), kind("entity_terminator").alias("ends"), F.sum("length").alias("bytes"), F.max(F.when(c("kind") == "file_terminator", c("offset"))).alias("last_offset")
    )
    return found


@query("SELECT c_custkey, md5('P' || chr(10) || (c_custkey + 1) || chr(10) || c_custkey || chr(10) || '7' || chr(10)) AS digest FROM customer")
def q32_span_slices(spark, sf_dir):
    t, k = table(spark, sf_dir, "customer"), c("c_custkey")
    made = S.drawings(S.rows(t, many_drawings(k), 61, 61, k, S.p(k + 1, k, 7)))
    odd = c(KEY).cast("int") % 2 == 1
    rows = corpus.read(spark, made.where(~odd).unionByName(zipped(made.where(odd))), mode="FAILFAST")
    spans = rows.records.select(KEY, "entity_id", "offset", c("payload_length").alias("length"))
    return rows.slices(spans).select((c("entity_id") - 1).alias("c_custkey"), F.md5("bytes").alias("digest"))


@query("""SELECT ['MI_MISSING_FILE_TERMINATOR', 'MI_TRAILING_DATA', 'MI_UNTERMINATED_RECORD', 'MI_MIXED_LINE_ENDINGS'][kind] AS code, count(*) AS n, count(*) FILTER (kind = 3) AS unframed
          FROM (SELECT c_custkey % 5 AS kind FROM customer) WHERE kind > 0 GROUP BY kind""")
def q33_loose_ends(spark, sf_dir):
    t = table(spark, sf_dir, "customer")

    def some(i: int, tail: str, **options) -> DataFrame:
        k = c("c_custkey")
        return S.drawings(S.rows(t.where(k % 5 == i), k, 61, 61, k, S.p(k, 1, 2), F.lit(tail)), **options)

    made = _union([some(0, ""), some(1, "", end=""), some(2, "", end="##~~\nmore\n"), some(3, "P\n77\n1\n"), some(4, "\r\n")])
    rows = corpus.read(spark, made, mode="FAILFAST")
    loose = rows.records.where("record_type is null").groupBy().agg(F.count("*").alias("k"))
    notes = _tally(rows.scan.where("row = 'diagnostic' and diagnostic.phase = 0").select("diagnostic.code"), "code")
    marked = loose.select(F.lit("MI_UNTERMINATED_RECORD").alias("code"), c("k").alias("unframed"))
    return notes.join(marked, "code", "left").select("code", "n", F.coalesce("unframed", F.lit(0)).cast("bigint").alias("unframed"))


@query("SELECT s_suppkey, '#~4294967296' AS field, CAST(4294967295 AS BIGINT) AS number FROM supplier")
def q34_marker_overflow(spark, sf_dir):
    t, k = table(spark, sf_dir, "supplier"), c("s_suppkey")
    rows = read(spark, S.rows(t, k, 61, 61, k, S.record("MYSTERY", k, "#~4294967296"), F.lit("#~4294967295\nrest\n")))
    kept = rows.records_of_type("MYSTERY").select(KEY, c("entity_id").alias("s_suppkey"), F.get("fields", F.lit(2)).alias("field"))
    return kept.join(rows.find_sections(4294967295).select(KEY, "number"), KEY).select("s_suppkey", "field", "number")


@query("""SELECT o_orderkey // 1000 AS drawing, 3 * count(*) + 1 AS records, CAST(3 AS BIGINT) AS sections, 2 * count(*) AS points, count(*) AS lines, CAST(5 + 20 * count(*) AS BIGINT) AS line_count FROM orders GROUP BY ALL""")
def q35_summary(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), c("o_orderkey") * 3
    d = many_drawings(c("o_orderkey"))
    parts = [
        S.rows(o.select(d.alias("d")).distinct(), c("d"), 6, 6, F.lit(0), F.lit("Top\n")), S.rows(o, d, 61, 61, k, S.p(k + 1, 0, 0), S.p(k + 2, 1, 1)), S.rows(o, d, 62, 62, k, S.lin(k + 3, k + 1, k + 2)),
    ]
    rows = read(spark, *parts).summary()
    types = c("record_types")
    return rows.select(c(KEY).cast("bigint").alias("drawing"), c("record_count").alias("records"), c("section_count").alias("sections"), types["P"].alias("points"), types["LIN"].alias("lines"), c("line_count").cast("bigint").alias("line_count"))


def _customer_bytes(df: DataFrame, spoil) -> DataFrame:
    """Drawings of customers in gzip envelopes; ``spoil`` gets the bytes and the key."""

    def run(batches):
        for batch in batches:
            packed = [spoil(gzip.compress(x, 1, mtime=0), int(k)) for k, x in zip(batch.column(KEY).to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(KEY), pa.array(packed, pa.binary())], names=[KEY, "content"])

    return df.mapInArrow(run, "drawing_id string, content binary")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 6 = 5 THEN 'LimitExceeded' ELSE 'InvalidDrawing' END AS class FROM customer""")
def q36_gzip_errors(spark, sf_dir):
    """Whole, cut short, followed by more bytes, by a second member, with a wrong checksum, and beyond the ratio of sizes."""
    t, k = table(spark, sf_dir, "customer"), c("c_custkey")
    long = F.when(k % 6 == 5, F.repeat(F.lit("x"), 60_000)).otherwise("")

    def spoil(x: bytes, key: int) -> bytes:
        return (x, x[:-5], x + b"more", x + x, x[:-8] + bytes([x[-8] ^ 1]) + x[-7:], x)[key % 6]

    made = _customer_bytes(S.drawings(S.rows(t, k, 61, 61, k, S.p(k, 1, 2), long, F.lit("\n"))), spoil)
    rows = corpus.read(spark, made, Limits(max_compression_ratio=100))._drawings
    return rows.select(c(KEY).cast("bigint").alias("c_custkey"), c("error.class").alias("class"))


@query("""SELECT CASE WHEN c_custkey % 4 = 1 THEN 'InvalidDrawing' WHEN c_custkey % 4 = 2 THEN 'UnsupportedDrawing' WHEN c_custkey % 4 = 3 AND c_custkey % 7 > 3 THEN 'LimitExceeded' ELSE 'read' END AS outcome,
          count(*) AS n FROM customer GROUP BY ALL""")
def q37_failures_stay_apart(spark, sf_dir):
    """No drawing, an envelope that is not decoded, and more lines than allowed; the others are read."""
    t, k = table(spark, sf_dir, "customer"), c("c_custkey")
    many = F.repeat(F.lit("line\n"), (k % 7).cast("int"))
    content = F.when(k % 4 == 1, F.concat(F.lit("no drawing "), c("c_name"))).when(k % 4 == 2, "PK\x03\x04rest").otherwise(F.concat(F.lit("#~1\n"), F.when(k % 4 == 3, many).otherwise(""), F.lit("##~~\n")))
    # The table may be one row group, which one task would read and frame; few bytes make much work here, so the number of tasks is told.
    made = t.repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey").select(k.cast("string").alias(KEY), F.encode(content, "ISO-8859-1").alias("content"))
    rows = corpus.read(spark, made, Limits(max_lines=5))
    return _tally(rows._framed_drawings.select(F.coalesce("error.class", F.lit("read")).alias("outcome")), "outcome")


@query("SELECT s_suppkey, s_acctbal AS x FROM supplier")
def q38_files(spark, sf_dir):
    """Drawings as files in folders of folders, found by a pattern; files of other names stay unread."""
    t, k = table(spark, sf_dir, "supplier"), c("s_suppkey")
    made = S.drawings(S.rows(t, many_drawings(k), 61, 61, k, S.p(k + 1, c("s_acctbal"), 0)), end="##~~")
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    texts = made.select(c(KEY).alias("folder"), c("content").cast("string").alias("value"))
    texts.repartition("folder").write.partitionBy("folder").text(path)
    rows = corpus.read(spark, path, mode="FAILFAST", glob="part-*")
    return rows.points.select((c("entity_id") - 1).alias("s_suppkey"), "x")


# Records


@query("""SELECT p_partkey, 'DTA' AS mi_type, CAST(p_size AS DOUBLE) AS value, 'font alt sym' AS label FROM part UNION ALL SELECT p_partkey, t, p_size + 1, '2' FROM part, (VALUES ('DTF'), ('DDA')) AS v(t)
          UNION ALL SELECT p_partkey, t, p_retailprice, '2' FROM part, (VALUES ('DLA'), ('DAF')) AS v(t) UNION ALL SELECT p_partkey, 'HAPP', p_size + 0.5, '2:5' FROM part""")
def q39_properties(spark, sf_dir):
    t, k = table(spark, sf_dir, "part"), c("p_partkey") * 10
    made = [S.record("DTA", k + 1, 5, "font", "alt", "sym", c("p_size"), 1.5), *[S.record(n, k + 2 + i, 2, c("p_size") + 1, -7) for i, n in enumerate(("DTF", "DDA"))]]
    made += [*[S.record(n, k + 4 + i, 2, c("p_retailprice"), 0.5) for i, n in enumerate(("DLA", "DAF"))], S.record("HAPP", k + 6, 2, 0, 1, 0.5, 2, 3, 1, c("p_size") + 0.5, 0.25, 4, 5)]
    rows = read(spark, S.rows(t, many_drawings(c("p_partkey")), 42, 42, k, *made)).properties
    text, lines = c("dimension_text_attribute"), c("hatch_pattern")
    fonts = F.concat_ws(" ", text["font_name"]["text"], text["alternate_font_name"]["text"], text["symbol_font_name"]["text"])
    table_ = F.coalesce(c("integer_definition").cast("array<double>"), c("numeric_definition"))
    value = F.coalesce(F.get(text["definition_values"], F.lit(0)), F.get(table_, F.lit(0)), F.get(lines, F.lit(1))["distance"])
    label = F.when(text.isNotNull(), fonts).when(table_.isNotNull(), F.size(table_).cast("string")).otherwise(F.concat_ws(":", F.size(lines).cast("string"), F.get(lines, F.lit(1))["linetype"].cast("string")))
    return rows.select(F.floor((c("entity_id") - 1) / 10).alias("p_partkey"), "mi_type", value.alias("value"), label.alias("label"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN true END AS ccw, CAST(s_suppkey + 1 AS DOUBLE) AS radius, 'FIL' AS mi_type FROM supplier")
def q40_fillets(spark, sf_dir):
    t, k, r = table(spark, sf_dir, "supplier"), c("s_suppkey") * 4, c("s_suppkey") + 1
    d = many_drawings(c("s_suppkey"))
    parts = [
        S.rows(t, d, 61, 61, k, S.p(k + 1, 0, 0), S.p(k + 2, r, 0), S.p(k + 3, 0, r)),
        S.rows(t, d, 62, 62, k, S.arc(k + 4, k + 1, k + 2, k + 3, c("s_suppkey") % 2, "FIL")),
    ]
    return read(spark, *parts).arcs.select(F.floor((c("entity_id") - 4) / 4).alias("s_suppkey"), "ccw", "radius", "mi_type")


@query("""SELECT c_custkey, c_name AS name, '2.10' AS version, 'mm' AS unit, 'RAD' AS angle_unit, 'A4' AS paper, CAST(1 AS DOUBLE) AS scale, CAST(10 AS DOUBLE) AS width, CAST(10 AS DOUBLE) AS height,
          CAST(4 AS DOUBLE) AS trace, '1-Jan-26 0:00:00' AS made FROM customer""")
def q41_global_section(spark, sf_dir):
    t = table(spark, sf_dir, "customer")
    g = c("global")
    rows = read(spark, S.rows(t, c("c_custkey"), -1, 3, F.lit(0), S.global_section("2.10", c("c_name")))).drawings
    return rows.select(
        c(KEY).cast("bigint").alias("c_custkey"), g["drawing_name"].alias("name"), g["version"].alias("version"), g["unit"].alias("unit"), g["angle_unit"].alias("angle_unit"), g["paper_size"].alias("paper"),
        g["drawing_scale"].alias("scale"), g["extents"]["width"].alias("width"), g["extents"]["height"].alias("height"), F.aggregate(g["transform_values"], F.lit(0.0), lambda a, x: a + x).alias("trace"),
        F.concat_ws(" ", g["creation_date"], g["creation_time"]).alias("made"),
    )


@query(f"""SELECT s_suppkey, t AS mi_type, s_acctbal + i AS measurement, CAST(i AS DOUBLE) AS x, 'len ' || s_suppkey AS label
           FROM supplier, (VALUES {", ".join(f"('{n}', {i})" for i, n in enumerate(DIMENSIONS))}) AS v(t, i)""")
def q42_dimension_types(spark, sf_dir):
    t, k = table(spark, sf_dir, "supplier"), c("s_suppkey") * 10
    made = []
    for i, (name, (_, _, _, position, measure)) in enumerate(DIMENSIONS.items()):
        body: list = [0] * 75
        body[position], body[position + 1], body[measure], body[measure + 1] = i, 2.5, c("s_acctbal") + i, F.concat(F.lit("len "), c("s_suppkey").cast("string"))
        made.append(S.record(name, k + i, 0, *body))
    rows = read(spark, S.rows(t, many_drawings(c("s_suppkey")), 71, 71, k, *made)).dimensions
    return rows.select(F.floor(c("entity_id") / 10).alias("s_suppkey"), "mi_type", "measurement", c("text_position.x").alias("x"), c("formatted_text.text").alias("label"))


@query("""SELECT s_suppkey, ['left', 'center', 'right'][s_suppkey % 3 + 1] AS across, ['lower', 'middle', 'upper'][s_suppkey % 9 // 3 + 1] AS up, CAST(s_suppkey AS DOUBLE) AS upper_value, count(*) AS n
          FROM supplier, generate_series(1, 2) GROUP BY s_suppkey""")
def q43_tolerances(spark, sf_dir):
    """Two references of one dimension to one tolerance give it once; alignment names come from its code."""
    t, k = table(spark, sf_dir, "supplier"), c("s_suppkey") * 10 + 1000
    body: list = [0] * 72
    body[7], body[8], body[20], body[21], body[30], body[32], body[34] = 1.5, 2.5, c("s_acctbal"), "x", k + 2, k + 3, k + 2
    d = many_drawings(c("s_suppkey"))
    dtv = lambda key, value: S.record("DTV", key, 1, value, -1, 0, "up", "down", 0, c("s_suppkey") % 9 + 1)
    rows = read(spark, S.rows(t, d, 42, 42, k, dtv(k + 2, c("s_suppkey")), dtv(k + 3, 1)), S.rows(t, d, 71, 71, k, S.record("DSGL", k + 1, 0, *body))).dimension_tolerances
    first = F.get("tolerances", F.lit(0))
    return rows.select(F.floor((c("entity_id") - 1001) / 10).alias("s_suppkey"), first["horizontal"].alias("across"), first["vertical"].alias("up"), first["upper_value"].alias("upper_value"), F.size("tolerances").cast("bigint").alias("n"))


@query("""SELECT p_partkey, CAST(p_size + 0.5 AS DOUBLE) AS distance, CAST(1 + p_size % 2 AS INTEGER) AS loops, p_size % 2 = 1 AS closed FROM part""")
def q44_hatch_contours(spark, sf_dir):
    """A hatch with its pattern, the first among its properties, and with its loops as contours."""
    t, k, more = table(spark, sf_dir, "part"), c("p_partkey") * 10, c("p_size") % 2
    d = many_drawings(c("p_partkey"))
    pattern = lambda key, value: S.record("HAPP", key, 1, 0, value, 0.5, 2, 3)
    inner = F.when(more == 1, F.array((k + 5).cast("string"))).otherwise(F.array().cast("array<string>"))
    hatch = S.record("HAT", k + 1, 1, 0, 0.5, 9, 3, k + 7, k + 2, k + 3, 0, 0, 0.5, 1)
    loop = lambda i: S.record("COC", k + i, *S.STYLE, more, 0, 1, k + 8)
    parts = [
        S.rows(t, d, 42, 42, k, S.record("PSTAT", k + 7, 0, 1), pattern(k + 2, c("p_size") + 0.5), pattern(k + 3, 1)),
        S.rows(t, d, 72, 72, k, hatch, loop(4), loop(5), S.record("PFA", k + 6, 0, k + 1, k + 4, more, S.many(inner))),
    ]
    rows = read(spark, *parts).hatch_contours
    return rows.select(F.floor((c("entity_id") - 1) / 10).alias("p_partkey"), F.get("pattern", F.lit(0))["distance"].alias("distance"), F.size("boundary_loops").alias("loops"), F.get("boundary_loops", F.lit(0))["closed"].alias("closed"))


# Text


def _name_bytes(df: DataFrame, key: Column, text) -> DataFrame:
    return S.rows(df, key, 62, 62, key, S.record("TEX", key + 1, *S.STYLE, 1, 1, 0, 5, 0, 1, 7, 0, 0, 1, 0, 0, "font", "other font", 0, 0, 2, 4, 0, 1.5, 0, 1, text, 0))


def _declared(df: DataFrame, key: Column, *labels: str) -> DataFrame:
    return S.rows(df, key, -3, 1, F.lit(0), F.lit("".join(f"ENCODING: {x}\n" for x in labels)))


def _hiragana(size: Column) -> Column:
    """Two bytes of Shift_JIS as two characters."""
    return F.concat(F.lit("\x82"), F.chr(size % 80 + 159))


@query("SELECT p_partkey, chr(CAST(12353 + p_size % 80 AS INTEGER)) || 'a' AS text, 'declared' AS source FROM part")
def q45_shift_jis(spark, sf_dir):
    t, k = table(spark, sf_dir, "part"), c("p_partkey")
    rows = read(spark, _declared(t, k, "Shift-JIS"), _name_bytes(t, k, F.concat(_hiragana(c("p_size")), F.lit("a"))), charset="ISO-8859-1")
    return rows.texts.join(rows._drawings.select(KEY, "encoding.source"), KEY).select((c("entity_id") - 1).alias("p_partkey"), "text", "source")


_ROMAN8 = bytes(range(0xC0, 0xE0)).decode("hp_roman8")


@query(f"SELECT p_partkey, '{_ROMAN8}'[p_size % 32 + 1] || '!' AS text FROM part")
def q46_roman8(spark, sf_dir):
    t, k = table(spark, sf_dir, "part"), c("p_partkey")
    rows = read(spark, _declared(t, k, "HP_Roman8"), _name_bytes(t, k, F.concat(F.chr(c("p_size") % 32 + 192), F.lit("!"))), charset="ISO-8859-1")
    return rows.texts.select((c("entity_id") - 1).alias("p_partkey"), "text")


@query("SELECT p_partkey, chr(CAST(12353 + p_size % 80 AS INTEGER)) AS text, 'override' AS source, p_partkey % 2 = 1 AS conflict FROM part")
def q47_encoding_override(spark, sf_dir):
    """An encoding given by the reader goes before a declaration, which is noted if it differs."""
    t, k = table(spark, sf_dir, "part"), c("p_partkey")
    made = S.drawings(_declared(t.where(k % 2 == 1), k, "roman8"), _name_bytes(t, k, _hiragana(c("p_size"))), charset="ISO-8859-1")
    rows = corpus.read(spark, made, encoding="cp932", mode="FAILFAST")
    notes = rows.notes.where("code = 'MI_ENCODING_CONFLICT'").select(KEY, F.lit(True).alias("conflict"))
    found = rows.texts.join(rows._drawings.select(KEY, "encoding.source"), KEY).join(notes, KEY, "left")
    return found.select((c("entity_id") - 1).alias("p_partkey"), "text", "source", F.coalesce("conflict", F.lit(False)).alias("conflict"))


@query(r"""WITH t AS (SELECT doc_id, regexp_matches(coalesce(text, ''), '[^\x00-\x7F]') AS odd FROM documents)
          SELECT doc_id // 4 % 8 AS place, CASE WHEN doc_id % 4 = 3 THEN 'undetermined' WHEN doc_id % 4 = 2 OR odd THEN 'heuristic' ELSE 'ascii_only' END AS source,
                 CASE WHEN doc_id % 4 = 3 THEN '-' WHEN doc_id % 4 = 2 THEN 'shift_jis' WHEN odd THEN 'utf-8' ELSE '-' END AS name, count(*) AS n FROM t GROUP BY ALL""")
def q48_encoding_heuristics(spark, sf_dir):
    """Undeclared texts at each of the eight places that are looked at: whole documents in UTF-8, their ASCII after a character of Shift_JIS, and after bytes that are neither."""
    t, k = table(spark, sf_dir, "documents"), c("doc_id")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]", " ")
    ascii_ = F.regexp_replace(text, r"[^\x20-\x7E]", " ")
    said = F.when(k % 4 <= 1, text).when(k % 4 == 2, F.concat(F.lit("\x82\xa0"), ascii_)).otherwise(F.concat(F.lit("a\xff\xff"), ascii_))
    place = F.floor(k / 4) % 8
    heads = [S.global_section("2.10", said), *[F.replace(S.global_section("2.10", "name"), F.lit(old), F.concat(F.lit("\n"), said, F.lit("\n"))) for old in ("\n1-Jan-26\n", "\n0:00:00\n", "\nsynthetic writer\n")]]
    body: list = ["TEX", k, *[0] * 27, "last"]
    fields = lambda i: S.record(*[said if j == i else x for j, x in enumerate(body)])
    made = F.when(place == 4, F.concat(F.lit(" \n"), said, F.lit("\n"))).when(place == 5, fields(19)).when(place == 6, fields(28)).when(place == 7, S.record("ASSE", k, 0, said, 0, 0, 0, 0, 0, 0))
    for i, head in enumerate(heads):
        made = F.when(place == i, head).otherwise(made)
    number = F.when(place < 4, 3).when(place == 4, 6).when(place == 7, 5).otherwise(62)
    rows = lambda df: S.rows(df, k, 0, number, F.lit(0), made)
    drawings = _union([S.drawings(rows(t.where(k % 4 <= 1))), S.drawings(rows(t.where(k % 4 > 1)), charset="ISO-8859-1")])
    found = corpus.read(spark, drawings, mode="FAILFAST")._drawings.select((F.floor(c(KEY).cast("bigint") / 4) % 8).alias("place"), "encoding.source", F.coalesce("encoding.name", F.lit("-")).alias("name"))
    return found.groupBy("place", "source", "name").agg(F.count("*").alias("n"))


@query("""SELECT ['MI_UNSUPPORTED_DECLARED_ENCODING', 'MI_CONFLICTING_ENCODING_DECLARATION', 'MI_ENCODING_CONFLICT', 'MI_ENCODING_GUESSED', 'MI_ENCODING_UNDETERMINED'][s_suppkey % 5 + 1] AS code, count(*) AS n
          FROM supplier GROUP BY ALL""")
def q49_encoding_codes(spark, sf_dir):
    t, k = table(spark, sf_dir, "supplier"), c("s_suppkey")
    of = lambda i: t.where(k % 5 == i)
    head = lambda df, name: S.rows(df, k, -1, 3, F.lit(0), S.global_section("2.10", name))
    latin = {"charset": "ISO-8859-1"}
    made = [
        S.drawings(_declared(of(0), k, "martian"), head(of(0), "x")), S.drawings(_declared(of(1), k, "sjis", "roman8"), head(of(1), "x")), S.drawings(_declared(of(2), k, "sjis"), head(of(2), "x"), mark=b"\xef\xbb\xbf"),
        S.drawings(head(of(3), "\xc3\xa9"), **latin), S.drawings(head(of(4), "\xff"), **latin),
    ]
    rows = corpus.read(spark, _union(made), mode="FAILFAST")
    return _tally(rows.notes.where("phase = 1").select("code"), "code")


@query("SELECT p_partkey, 'FF' AS bad, 'TEX field 29 fails at byte ' || (3 + p_size % 5) AS message FROM part")
def q50_text_error_spans(spark, sf_dir):
    """The span of a text error is the bad byte itself, though lines end in two bytes."""
    t, k = table(spark, sf_dir, "part"), c("p_partkey")
    text = F.concat(F.repeat(F.lit("x"), (c("p_size") % 5 + 3).cast("int")), F.lit("\xff tail"))
    rows = read(spark, _declared(t, k, "utf-8"), _name_bytes(t, k, text), charset="ISO-8859-1", newline="\r\n")
    notes = rows.diagnostics.where("code = 'MI_TEXT_DECODE_ERROR'").select(KEY, "message", "span.offset", "span.length")
    return rows.slices(notes).select(c(KEY).cast("bigint").alias("p_partkey"), F.hex("bytes").alias("bad"), "message")


# Diagnostics


@query("""SELECT ['MI_EMPTY_PART_NAME', 'MI_ENTITY_SECTION_OUTSIDE_PART', 'MI_INVALID_ENTITY_ID', 'MI_GLOBAL_RECORD_TOO_SHORT', 'MI_GLOBAL_LAYOUT_UNVERIFIED', 'MI_INVALID_TOC_LAST', 'MI_DANGLING_PROPERTY_REFERENCE',
          'MI_DANGLING_ENTITY_REFERENCE', 'MI_INVALID_GLOBAL_FIELD'][s_suppkey % 9 + 1] AS code, count(*) AS n FROM supplier GROUP BY ALL""")
def q51_structure_codes(spark, sf_dir):
    t, k = table(spark, sf_dir, "supplier"), c("s_suppkey")
    of = lambda i: t.where(k % 9 == i)
    at = lambda i, number, *bodies: S.rows(of(i), k, number, number, F.lit(0), *bodies)
    wrong = F.replace(S.global_section(), F.lit("\n0\n10\n0\n10\n"), F.lit("\n0\nten\n0\n10\n"))
    rows = read(
        spark, at(0, 6, F.lit(" \n\n")), at(1, 61, S.p(1, 2, 3)), at(2, 42, S.record("PSTAT", "abc", 0, 1)), at(3, 3, F.lit("name\n" * 5)), at(4, 3, S.global_section("2.20")), at(5, 2, F.lit("LAST:abc\n")),
        at(6, 42, S.lin(5, 5, 5, (1, 0, 0.5, 9, 1, 77))), at(7, 42, S.record("COC", 5, *S.STYLE, 1, 0, 1, 77)), at(8, 3, wrong),
    )
    noise = ("MI_MISSING_GLOBAL_SECTION", "MI_REFERENCE_TYPE_MISMATCH")
    return _tally(rows.diagnostics.where(~c("code").isin(*noise)), "code")


@query("SELECT ['MI_UNBOUND_ASSEMBLY', 'MI_ASSEMBLY_PART_NAME_MISMATCH', 'MI_DANGLING_ASSEMBLY_REFERENCE', 'MI_REFERENCE_TYPE_MISMATCH'][s_suppkey % 4 + 1] AS code, count(*) AS n FROM supplier GROUP BY ALL")
def q52_assembly_codes(spark, sf_dir):
    t, k = table(spark, sf_dir, "supplier"), c("s_suppkey")
    part = S.rows(t.where(k % 4 > 0), k, 100, 6, F.lit(0), F.lit("A\n"))
    child = lambda target: F.array(S.child(target, 1, 2))
    at = lambda i, body: S.rows(t.where(k % 4 == i), k, 50, 5, F.lit(0), body)
    point = S.rows(t.where(k % 4 == 3), k, 101, 61, F.lit(0), S.p(7, 0, 0))
    rows = read(spark, part, point, at(0, S.asse(10, "A")), at(1, S.asse(10, "B")), at(2, S.asse(10, "A", child(999))), at(3, S.asse(10, "A", child(7))))
    return _tally(rows.diagnostics.where("code <> 'MI_MISSING_GLOBAL_SECTION'"), "code")


@query("SELECT o_orderkey % 3 AS kind, ['ok', 'dangling', 'mismatch'][o_orderkey % 3 + 1] AS status, count(*) AS n FROM orders GROUP BY ALL")
def q53_property_references(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), c("o_orderkey") * 10
    d = many_drawings(c("o_orderkey"))
    target = F.when(c("o_orderkey") % 3 == 0, k + 4).when(c("o_orderkey") % 3 == 1, k + 900000000000).otherwise(k + 1)
    parts = [S.rows(o, d, 42, 42, k, S.record("PSTAT", k + 4, 0, 1)), S.rows(o, d, 61, 61, k, S.p(k + 1, 0, 0)), S.rows(o, d, 62, 62, k, S.lin(k + 3, k + 1, k + 1, (1, 0, 0.5, 9, 1, target)))]
    found = read(spark, *parts).references.where("expected = 'property'")
    return found.groupBy((F.floor(c("entity_id") / 10) % 3).alias("kind"), "status").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, 'id ' || (c_custkey + 1) || ' was taken by entity ' || (row_number() OVER (PARTITION BY c_custkey // 1000 ORDER BY c_custkey) - 1) * 2 AS message FROM customer")
def q54_first_of_an_id(spark, sf_dir):
    t, k = table(spark, sf_dir, "customer"), c("c_custkey")
    rows = read(spark, S.rows(t, many_drawings(k), 61, 61, k, S.p(k + 1, 1, 2), S.p(k + 1, 3, 4)))
    notes = rows.diagnostics.where("code = 'MI_DUPLICATE_ENTITY_ID'")
    return notes.select((F.regexp_extract("message", "id ([0-9]+)", 1).try_cast("bigint") - 1).alias("c_custkey"), "message")


@query("SELECT event_id // 1000 AS drawing, value AS x, event_id AS source FROM events WHERE event_id % 1000 = 4")
def q55_lookup_by_id(spark, sf_dir):
    t, k = table(spark, sf_dir, "events"), c("event_id")
    rows = read(spark, S.rows(t, many_drawings(k), 61, 61, k, S.p(k % 1000 + 1, c("value"), k), S.p(k % 1000 + 1, -1, -1)))
    return rows.get(5).select(c(KEY).cast("bigint").alias("drawing"), c("point.x").alias("x"), c("point.y").cast("bigint").alias("source"))


# Queries and structure


@query("SELECT 'HAT' AS mi_type, count(*) AS n FROM part UNION ALL SELECT 'DTV', count(*) FROM part UNION ALL SELECT 'SYML', count(*) FROM part WHERE p_size % 2 = 0")
def q56_annotation_query(spark, sf_dir):
    t, k = table(spark, sf_dir, "part"), c("p_partkey") * 10
    hatch, leader = S.record("HAT", k + 1, *S.STYLE, 0, 0, 0.5, 1), S.record("LED", k + 2, *S.STYLE, 2, 3.5, 1, 0, 0, 0)
    symbol = F.when(c("p_size") % 2 == 0, S.record("SYML", k + 3, k + 1, k + 2, k + 4)).otherwise("")
    rows = read(spark, S.rows(t, many_drawings(c("p_partkey")), 72, 72, k, hatch, leader, symbol, S.record("DTV", k + 5, 1, 2, -1, 0, "up", "down", 0, 5)))
    return _tally(rows.query_annotations("hatch, Tolerance symbol"), "mi_type")


def _two_parts(spark, sf_dir) -> corpus.Corpus:
    """Lines of even orders in the part Top, of odd ones in another."""
    o, k = table(spark, sf_dir, "orders"), c("o_orderkey")
    d = many_drawings(k)
    each = o.select(d.alias("d")).distinct()
    odd = k % 2
    return read(spark, S.rows(each, c("d"), 20, 6, F.lit(0), F.lit("\nTOP\n")), S.rows(each, c("d"), 10, 6, F.lit(0), F.lit("Other\n")), S.rows(o, d, F.when(odd == 1, 11).otherwise(21), 62, k, S.lin(k + 1, 1, 2)))


@query("SELECT o_orderkey, o_orderkey % 2 = 0 AS is_top FROM orders")
def q57_scoped_query(spark, sf_dir):
    rows = _two_parts(spark, sf_dir)
    at = lambda i: rows.query("line", part=i).select((c("entity_id") - 1).alias("o_orderkey"), F.lit(i == 1).alias("is_top"))
    return at(0).unionByName(at(1))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0")
def q58_modelspace(spark, sf_dir):
    return _two_parts(spark, sf_dir).modelspace("line circle").select((c("entity_id") - 1).alias("o_orderkey"))


def _tree(spark, sf_dir) -> corpus.Corpus:
    """A drawing for each supplier: Top places A as a sheet, shifted and mirrored, and A places B twice; a line and a point in B."""
    t, k = table(spark, sf_dir, "supplier"), c("s_suppkey")
    row = lambda place, number, body: S.rows(t, k, place, number, F.lit(0), body)
    top = F.array(S.child(20, 0, 0, (1,), (1, 0, k * 10, 0, -1, 5, 0, 0, 1)))
    inner = F.array(S.child(30, 1, 0), S.child(30, 0, k))
    return read(
        spark, row(42, 42, S.assp(1, "DOCU_SHEET")), row(50, 5, S.asse(10, "Top", top)), row(51, 5, S.asse(20, "A", inner)), row(52, 5, S.asse(30, "B")), row(100, 6, F.lit("Top\n")), row(101, 6, F.lit("A\n")), row(102, 6, F.lit("B\n")),
        row(103, 61, F.concat(S.p(101, 0, 0), S.p(102, 3, 4))), row(104, 62, S.lin(103, 101, 102)),
    )


@query("""SELECT s_suppkey, i AS branch, s_suppkey * 10 + CAST(1 - i AS DOUBLE) AS tx, CAST(5 - i * s_suppkey AS DOUBLE) AS ty, '10:0/20:' || i AS path FROM supplier, generate_series(0, 1) AS g(i)""")
def q59_occurrence_paths(spark, sf_dir):
    rows = _tree(spark, sf_dir).occurrences().where("depth = 2")
    path = F.array_join(F.transform("path", lambda s: F.concat_ws(":", s["assembly_id"].cast("string"), s["instance_index"].cast("string"))), "/")
    return rows.select(c(KEY).cast("bigint").alias("s_suppkey"), F.get("order_key", F.lit(1)).alias("branch"), c("world.tx").alias("tx"), c("world.ty").alias("ty"), path.alias("path"))


@query("SELECT s_suppkey, CAST(1 AS INTEGER) AS depth, CAST(1 AS BIGINT) AS part_index FROM supplier")
def q60_sheet_occurrences(spark, sf_dir):
    return _tree(spark, sf_dir).sheet_instances().select(c(KEY).cast("bigint").alias("s_suppkey"), "depth", "part_index")


@query("SELECT s_suppkey, CAST(depth AS INTEGER) AS depth, CASE depth WHEN 0 THEN 1 ELSE 2 END AS n FROM supplier, generate_series(0, 1) AS g(depth)")
def q61_occurrences_below(spark, sf_dir):
    """From a part of one's own choice; not strict, so roots that are no part of the drawing are left out."""
    tree = _tree(spark, sf_dir)
    root = tree.part_names.where("name = 'A'").select(KEY, "part_index")
    strangers = root.select(KEY, F.lit(77).cast("bigint").alias("part_index"))
    found = tree.occurrences(root.unionByName(strangers), strict=False)
    return found.groupBy(c(KEY).cast("bigint").alias("s_suppkey"), "depth").agg(F.count("*").cast("int").alias("n"))


@query("SELECT s_suppkey, 3 AS n_parts, 0 AS top, '1' AS below_top, '2,2' AS below_a, '1' AS above_b, '0' AS roots FROM supplier")
def q62_part_tree(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    of = lambda i, name: F.max(F.when(c("part_index") == i, F.array_join(c(name).cast("array<string>"), ",")))
    rows = tree.parts.groupBy(KEY).agg(F.count("*").cast("int").alias("n_parts"), of(0, "child_part_indices").alias("below_top"), of(1, "child_part_indices").alias("below_a"), of(2, "parent_part_indices").alias("above_b"))
    roots = tree.roots.select(KEY, c("top_part_index").cast("int").alias("top"), F.array_join(c("root_part_indices").cast("array<string>"), ",").alias("roots"))
    return rows.join(roots, KEY).select(c(KEY).cast("bigint").alias("s_suppkey"), "n_parts", "top", "below_top", "below_a", "above_b", "roots")


# Shapes


@query("""SELECT s_suppkey, i, round((s_suppkey + 1) * cos(s_suppkey % 4 * pi() / 2 + i * pi() / 8), 6) + 0.0 AS x, round((s_suppkey + 1) * sin(s_suppkey % 4 * pi() / 2 + i * pi() / 8), 6) + 0.0 AS y
          FROM supplier, generate_series(0, 4) AS g(i)""")
def q63_arc_vertices(spark, sf_dir):
    t, k, r = table(spark, sf_dir, "supplier"), c("s_suppkey") * 4, c("s_suppkey") + 1
    axis = lambda n: (F.when(n % 4 == 0, r).when(n % 4 == 2, -r).otherwise(0), F.when(n % 4 == 1, r).when(n % 4 == 3, -r).otherwise(0))
    d = many_drawings(c("s_suppkey"))
    parts = [
        S.rows(t, d, 61, 61, k, S.p(k + 1, 0, 0), S.p(k + 2, *axis(c("s_suppkey"))), S.p(k + 3, *axis(c("s_suppkey") + 1))),
        S.rows(t, d, 62, 62, k, S.arc(k + 4, k + 1, k + 2, k + 3)),
    ]
    flat = read(spark, *parts).polylines(4).select(F.floor((c("entity_id") - 4) / 4).alias("s_suppkey"), F.posexplode("vertices").alias("i", "v"))
    return flat.select("s_suppkey", c("i").cast("bigint").alias("i"), (F.round("v.x", 6) + 0.0).alias("x"), (F.round("v.y", 6) + 0.0).alias("y"))


@query("""SELECT vec_id, i, CAST(i + 1 AS DOUBLE) AS x, round((CAST(embedding[i + 1] AS DOUBLE) + 4 * CAST(embedding[i + 2] AS DOUBLE) + CAST(embedding[i + 3] AS DOUBLE)) / 6, 6) + 0.0 AS y
          FROM embeddings, generate_series(0, 61) AS g(i)""")
def q64_cubic_bspline(spark, sf_dir):
    """At the knots of a uniform cubic spline a vertex is a mean of three control points, weighted 1, 4, 1."""
    t, d = table(spark, sf_dir, "embeddings"), many_drawings(c("vec_id"))
    k = c("vec_id") * 100
    controls = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (k + i).cast("string"))
    points = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: S.p(k + i + 1, i, F.get("embedding", i).cast("double"))), "")
    spline = S.record("BSPL", k + 99, *S.STYLE, 4, 0, 0, 64, k + 1, k + 64, 64, S.many(controls), 68, *range(68), 0)
    flat = read(spark, S.rows(t, d, 61, 61, k, points), S.rows(t, d, 62, 62, k, spline)).polylines(61).select(F.floor(c("entity_id") / 100).alias("vec_id"), F.posexplode("vertices").alias("i", "v"))
    return flat.select("vec_id", c("i").cast("bigint").alias("i"), F.round("v.x", 6).alias("x"), (F.round("v.y", 6) + 0.0).alias("y"))


@query("""SELECT s_suppkey, i AS branch, s_suppkey * 10 + CAST(1 - i + 3 * e AS DOUBLE) AS x, CAST(5 - i * s_suppkey - 4 * e AS DOUBLE) AS y, e AS vertex FROM supplier, generate_series(0, 1) AS g(i), generate_series(0, 1) AS h(e)""")
def q65_placed_polylines(spark, sf_dir):
    flat = _tree(spark, sf_dir).polylines(8, expand=True).select(c(KEY).cast("bigint").alias("s_suppkey"), F.get("path", F.lit(1))["instance_index"].alias("branch"), F.posexplode("vertices").alias("i", "v"))
    return flat.select("s_suppkey", "branch", c("v.x").alias("x"), c("v.y").alias("y"), c("i").cast("bigint").alias("vertex"))


@query("""SELECT p_partkey, ['left', 'center', 'right'][p_size % 3 + 1] AS across, ['lower', 'middle', 'upper'][p_size % 9 // 3 + 1] AS up, CAST(5 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) - 2 AS y, CAST(0.5 AS DOUBLE) AS width_factor
          FROM part""")
def q66_text_baselines(spark, sf_dir):
    t, k = table(spark, sf_dir, "part"), c("p_partkey")
    record = S.record("TEX", k + 1, *S.STYLE, c("p_size") % 9 + 1, 1, 0, 5, 0, 1, c("p_size"), 0, 0, 1, 0, 0, "font", "other font", 0, 0, 2, 4, 0, 1.5, 0, 1, "word", 0)
    rows = polylines.text_baselines(read(spark, S.rows(t, many_drawings(k), 62, 62, k, record)).texts)
    return rows.select((c("entity_id") - 1).alias("p_partkey"), c("horizontal").alias("across"), c("vertical").alias("up"), c("baseline.x").alias("x"), c("baseline.y").alias("y"), "width_factor")


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'unknown orientation' WHEN 1 THEN 'unresolved geometry' ELSE 'undecoded text' END AS reason, 1 AS n, s_suppkey * 4 + 4 AS first_id FROM supplier""")
def q67_skipped(spark, sf_dir):
    """What a preview leaves out: an arc of unknown orientation, a line without an end, a text that is not in its encoding."""
    t, k = table(spark, sf_dir, "supplier"), c("s_suppkey") * 4
    points = S.rows(t, c("s_suppkey"), 61, 61, k, S.p(k + 1, 0, 0), S.p(k + 2, 1, 0), S.p(k + 3, 0, 1))
    text = S.record("TEX", k + 4, *S.STYLE, 1, 1, 0, 5, 0, 1, 7, 0, 0, 1, 0, 0, "font", "other font", 0, 0, 2, 4, 0, 1.5, 0, 1, "\xff", 0)
    body = F.when(c("s_suppkey") % 3 == 0, S.arc(k + 4, k + 1, k + 2, k + 3, 1)).when(c("s_suppkey") % 3 == 1, S.lin(k + 4, k + 1, k + 900000000)).otherwise(text)
    rows = read(spark, _declared(t, c("s_suppkey"), "utf-8"), points, S.rows(t, c("s_suppkey"), 62, 62, k, body), charset="ISO-8859-1").skipped(4)
    return rows.select(c(KEY).cast("bigint").alias("s_suppkey"), "reason", c("count").cast("int").alias("n"), F.get("entity_ids", F.lit(0)).alias("first_id"))


@query("""SELECT c_custkey, round(p * 2 - c_acctbal / 100, 6) AS x, round(q + c_custkey / 7, 6) AS y, round((CAST(5 AS DOUBLE) + c_acctbal / 100) / 2, 6) AS u, round(CAST(1 AS DOUBLE) - c_custkey / 7, 6) AS v
          FROM (SELECT c_custkey, c_acctbal, CAST(3 AS DOUBLE) + c_custkey AS p, CAST(4 AS DOUBLE) * 3 AS q FROM customer)""")
def q68_affine_apply(spark, sf_dir):
    """m after n on a point, and the inverse of m on another: m doubles x and shifts, n shifts x and triples y."""
    t = table(spark, sf_dir, "customer")
    m, n = G.affine(2, 0, 0, 1, -c("c_acctbal") / 100, c("c_custkey") / 7), G.affine(1, 0, 0, 3, c("c_custkey").cast("double"), 0)
    rows = t.select("c_custkey", m.alias("m"), n.alias("n"), G.point(F.lit(3.0), F.lit(4.0)).alias("p"), G.point(F.lit(5.0), F.lit(1.0)).alias("q"))
    both = rows.select("c_custkey", G.apply(G.compose(c("m"), c("n")), c("p")).alias("a"), G.apply(G.inverse(c("m")), c("q")).alias("b"))
    return both.select("c_custkey", F.round("a.x", 6).alias("x"), F.round("a.y", 6).alias("y"), F.round("b.x", 6).alias("u"), F.round("b.y", 6).alias("v"))


@query("""WITH s AS (SELECT ['solid', 'dashed', 'dotted', 'dot_center', 'dash_dot_dot', 'long_dashed', 'dash_center', 'phantom', 'legacy_phantom', 'short_dash', 'center_dash_dash', 'long_dash_short_dash',
          'long_dash_two_short_dash'] AS names) SELECT names[o_orderkey % 14 + 1] AS linetype, count(*) AS n FROM orders, s GROUP BY ALL""")
def q69_linetypes(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), c("o_orderkey")
    rows = read(spark, S.rows(o, many_drawings(k), 62, 62, k, S.lin(k + 1, 1, 2, (1, k % 14, 0.5, 9, 0)))).graphics
    return _tally(rows.select(G.linetype_name(c("graphic.linetype")).alias("linetype")), "linetype")


@query("""SELECT 'raw' AS metric, 'LED' AS item, '' AS value, count(*) AS n FROM orders UNION ALL SELECT 'typed', 'LED', '', count(*) FROM orders UNION ALL
          SELECT 'leader_vertex_counts', 'LED', CAST(o_orderkey % 4 + 1 AS VARCHAR), count(*) FROM orders GROUP BY ALL UNION ALL
          SELECT 'field_counts', 'LED', CAST(10 + 3 * (o_orderkey % 4 + 1) AS VARCHAR), count(*) FROM orders GROUP BY ALL UNION ALL
          SELECT 'property_counts', 'graphics', '0', count(*) FROM orders UNION ALL SELECT 'lineweights', 'graphics', '0.5', count(*) FROM orders UNION ALL
          SELECT 'layer_counts', 'graphics', '0', count(*) FROM orders UNION ALL SELECT 'visibility', 'graphics', 'null', count(*) FROM orders UNION ALL
          SELECT 'visibility_values', 'graphics', '9', count(*) FROM orders UNION ALL SELECT 'diagnostic_codes', code, '', count(DISTINCT o_orderkey // 1000) FROM orders, (VALUES ('MI_MISSING_GLOBAL_SECTION'), ('MI_ENTITY_SECTION_OUTSIDE_PART')) AS v(code) GROUP BY code""")
def q70_audit_metrics(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), c("o_orderkey")
    n = k % 4
    vertices = F.flatten(F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: F.array((k + i).cast("string"), i.cast("string"), F.lit("0"))))
    rows = read(spark, S.rows(o, many_drawings(k), 71, 71, k, S.record("LED", k + 1, *S.STYLE, 2, 3.5, n + 1, S.many(vertices)))).audit()
    left = ("colors", "color_names", "linetypes")
    return rows.where(~c("metric").isin(*left)).select("metric", "item", "value", c("count").alias("n"))


# Attachments


def _linked(spark, sf_dir) -> corpus.Corpus:
    """For each supplier a line, a dimension, a contour and a symbol, of whose pointers some mean nothing."""
    t, n = table(spark, sf_dir, "supplier"), c("s_suppkey")
    k, d = n * 20, many_drawings(n)
    dim: list = [0] * 75
    dim[0], dim[1], dim[2], dim[3], dim[7], dim[8], dim[16], dim[18], dim[20], dim[21] = k + 2, k + 18, k + 19, k + 1, 1.5, 2.5, k + 7, k + 17, 5, "five"
    return read(
        spark, S.rows(t, d, 41, 41, k, S.record("PSTAT", k + 5, 0, 1), S.assp(k + 7, "here"), S.assp(k + 9, F.concat(F.lit("LAYER:"), (n % 3).cast("string")))), S.rows(t, d, 61, 61, k, S.p(k + 1, n, 1)),
        S.rows(t, d, 62, 62, k, S.lin(k + 2, k + 1, k + 16, (1, 0, 0.5, 9, 2, k + 15, k + 5))),
        S.rows(t, d, 71, 71, k, S.record("DSGL", k + 3, 2, k + 15, k + 5, *dim), S.record("COC", k + 4, 1, 0, 0.5, 9, F.when(n % 2 == 0, F.concat_ws("\n", F.lit("1"), (k + 9).cast("string"))).otherwise("0"), 1, 0, 2, k + 2, k + 14), S.record("SYML", k + 8, k + 2, k + 1, k + 4)),
    )


@query("""SELECT s_suppkey, kind, CASE WHEN kind IN ('line', 'dimension') THEN 'PSTAT' WHEN kind = 'contour' AND s_suppkey % 2 = 0 THEN 'ASSP' ELSE '' END AS properties,
          CASE kind WHEN 'dimension' THEN 'LIN ' || (s_suppkey * 20 + 2) || ',-' WHEN 'contour' THEN 'LIN ' || (s_suppkey * 20 + 2) || ',-' WHEN 'symbol' THEN 'LIN ' || (s_suppkey * 20 + 2) || ',-,-' ELSE '' END AS links,
          CASE kind WHEN 'line' THEN s_suppkey || ',-' WHEN 'dimension' THEN '-,' || s_suppkey ELSE '' END AS points, CASE kind WHEN 'dimension' THEN 'here' ELSE '-' END AS style, '-' AS text_style
          FROM supplier, (VALUES ('line'), ('dimension'), ('contour'), ('symbol')) AS v(kind)""")
def q71_attachments(spark, sf_dir):
    """Properties that resolve, and geometry, points, components and styles, null where an id is missing or means another class."""
    rows = _linked(spark, sf_dir).attachments.where("kind in ('line', 'dimension', 'contour', 'symbol')")
    told = lambda values, one: F.array_join(F.transform(values, lambda v: F.coalesce(one(v), F.lit("-"))), ",")
    link = lambda v: F.concat(v["mi_type"], F.lit(" "), v["entity_id"].cast("string"))
    style = lambda name: F.coalesce(F.get(c(name)["associated_strings"], F.lit(0))["text"], F.lit("-")).alias(name.removeprefix("dimension_"))
    return rows.select(
        F.floor(c("entity_id") / 20).alias("s_suppkey"), "kind", told("properties", lambda v: v["mi_type"]).alias("properties"), told(F.concat("geometries", "components"), link).alias("links"),
        told("points", lambda v: v["x"].cast("bigint").cast("string")).alias("points"), style("dimension_style"), style("text_style"),
    )


@query("""WITH s AS (SELECT count(*) AS n, count(*) FILTER (s_suppkey % 2 = 0) AS even FROM supplier)
          SELECT 'layer_counts' AS metric, 'graphics' AS item, '0' AS value, 2 * n - even AS n FROM s UNION ALL SELECT 'layer_counts', 'graphics', '1', even FROM s WHERE even > 0
          UNION ALL SELECT m, i, v, n FROM s, (VALUES ('geometry_reference_counts', 'DSGL', '2'), ('point_reference_counts', 'DSGL', '2'), ('unresolved_geometry', 'DSGL', '1'), ('unresolved_points', 'DSGL', '1'),
            ('contour_unresolved_components', 'COC', '1'), ('symbol_unresolved_components', 'SYML', '2')) AS v(m, i, v)""")
def q72_audit_references(spark, sf_dir):
    """Layers of graphics, and how many targets of each owner are missing or of another class."""
    rows = _linked(spark, sf_dir).audit()
    names = ("layer_counts", "geometry_reference_counts", "point_reference_counts", "unresolved_geometry", "unresolved_points", "contour_unresolved_components", "symbol_unresolved_components")
    return rows.where(c("metric").isin(*names)).select("metric", "item", "value", c("count").alias("n"))


@query("""SELECT o_orderkey // 1000 AS drawing, 3 * count(*) AS typed, CAST(0 AS BIGINT) AS unsupported, 2 * count(*) AS points, count(*) AS lines, '2.10' AS version, CAST(1 AS BIGINT) AS other_codes FROM orders GROUP BY ALL""")
def q73_audit_files(spark, sf_dir):
    """A row a file: counts by type and by code, with the version that the file declares."""
    o, k = table(spark, sf_dir, "orders"), c("o_orderkey") * 3
    d = many_drawings(c("o_orderkey"))
    top = S.rows(o.select(d.alias("d")).distinct(), c("d"), 6, 6, F.lit(0), F.lit("\n"))
    rows = read(spark, S.head(o, d), top, S.rows(o, d, 61, 61, k, S.p(k + 1, 0, 0), S.p(k + 2, 1, 1)), S.rows(o, d, 62, 62, k, S.lin(k + 3, k + 1, k + 2))).audit_files()
    raw = c("raw_record_counts")
    return rows.select(
        c(KEY).cast("bigint").alias("drawing"), c("typed_entities").alias("typed"), c("unsupported_entities").alias("unsupported"), raw["P"].alias("points"), raw["LIN"].alias("lines"), "version",
        c("diagnostic_codes")["MI_EMPTY_PART_NAME"].alias("other_codes"),
    )


@query("SELECT s_suppkey, CAST(3 + s_suppkey % 4 AS BIGINT) AS bytes, CAST(2 + s_suppkey % 4 AS BIGINT) AS last_line, CAST(3 + s_suppkey % 4 AS BIGINT) AS mark FROM supplier")
def q74_preamble(spark, sf_dir):
    """Blank lines before the first section are the preamble; sections begin after it."""
    t, k = table(spark, sf_dir, "supplier"), c("s_suppkey")
    made = S.drawings(S.rows(t, k, 61, 61, k, S.p(k, 1, 2)))
    blank = F.concat(F.lit(" \n\n"), F.repeat(F.lit("\n"), (made[KEY].cast("int") % 4)))
    rows = corpus.read(spark, made.select(KEY, F.concat(F.encode(blank, "UTF-8"), "content").alias("content")), mode="FAILFAST")
    spans = rows._drawings.select(KEY, "preamble_span.length", "preamble_span.end_line").join(rows.sections.select(KEY, "marker_span.offset"), KEY)
    return spans.select(c(KEY).cast("bigint").alias("s_suppkey"), c("length").alias("bytes"), c("end_line").alias("last_line"), c("offset").alias("mark"))


@query("""SELECT vec_id, CAST(vec_id % 63 AS DOUBLE) + 0.25 AS x, round(0.75 * CAST(embedding[vec_id % 63 + 1] AS DOUBLE) + 0.25 * CAST(embedding[vec_id % 63 + 2] AS DOUBLE), 6) + 0.0 AS y FROM embeddings""")
def q75_spline_at(spark, sf_dir):
    """A spline of degree 1 at a parameter of its own."""
    t, d = table(spark, sf_dir, "embeddings"), many_drawings(c("vec_id"))
    k = c("vec_id") * 100
    controls = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (k + i).cast("string"))
    points = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: S.p(k + i + 1, i, F.get("embedding", i).cast("double"))), "")
    spline = S.record("BSPL", k + 99, *S.STYLE, 2, 0, 0, 63, k + 1, k + 64, 64, S.many(controls), 66, 0, *range(64), 63, 0)
    rows = read(spark, S.rows(t, d, 61, 61, k, points), S.rows(t, d, 62, 62, k, spline)).bsplines
    n = F.floor(c("entity_id") / 100)
    at = rows.select(n.alias("vec_id"), G.evaluate((n % 63).cast("double") + 0.25).alias("p"))
    return at.select("vec_id", F.round("p.x", 6).alias("x"), (F.round("p.y", 6) + 0.0).alias("y"))


@query("""SELECT s_suppkey, 'CIR' AS record_type, CAST(s_suppkey % 1000 AS BIGINT) AS center FROM supplier""")
def q76_source_records(spark, sf_dir):
    """Records of a type through the data source, over files in folders of folders."""
    t, k = table(spark, sf_dir, "supplier"), c("s_suppkey")
    d = many_drawings(k)
    made = S.drawings(S.rows(t, d, 61, 61, k, S.p(k * 2 + 1, 0, 0)), S.rows(t, d, 62, 62, k, S.cir(k * 2 + 2, k % 1000, 1)), end="##~~")
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    texts = made.select(c(KEY).alias("folder"), c("content").cast("string").alias("value"))
    texts.repartition("folder").write.partitionBy("folder").text(path)
    reader.register(spark)
    rows = spark.read.format("drawings").options(table="records", mode="FAILFAST", pathGlobFilter="part-*").load(path).where("record_type = 'CIR'")
    return rows.select(((c("entity_id") - 2) / 2).cast("bigint").alias("s_suppkey"), "record_type", F.get("fields", F.lit(7)).cast("bigint").alias("center"))


@query("""WITH r AS (SELECT c_custkey // 1000 AS drawing, c_custkey % 90 AS y, max(c_nationkey) AS x FROM customer GROUP BY ALL)
          SELECT drawing, CAST(sum(x + 1) AS BIGINT) AS painted, CAST(100 AS BIGINT) AS width, CAST(90 AS BIGINT) AS height FROM r GROUP BY drawing""")
def q77_preview_images(spark, sf_dir):
    """Images of horizontal lines, some on top of others: painted pixels, and sizes as the PNG's header says."""
    t, k = table(spark, sf_dir, "customer"), c("c_custkey") * 3
    d = many_drawings(c("c_custkey"))
    ends = F.concat(S.p(k + 1, 0, c("c_custkey") % 90), S.p(k + 2, c("c_nationkey"), c("c_custkey") % 90))
    shapes = read(spark, S.rows(t, d, 61, 61, k, ends), S.rows(t, d, 62, 62, k, S.lin(k + 3, k + 1, k + 2))).polylines(2)
    pixels = raster.painted(raster.strokes(shapes), (0, 0, 99, 89), width=100, height=90, margin=0)
    size = lambda at: F.conv(F.hex(F.substring("png", at, 4)), 16, 10).cast("bigint")
    heads = raster.images(pixels, 100, 90).select(KEY, size(17).alias("width"), size(21).alias("height"))
    return pixels.groupBy(KEY).agg(F.count("*").alias("painted")).join(heads, KEY).select(c(KEY).cast("bigint").alias("drawing"), "painted", "width", "height")
