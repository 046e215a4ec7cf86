"""Registered queries: tables are written as drawings, the engine reads them, and SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import corpus
from ..functions import geometry as G
from ..operators.resolve import KEY
from ..sources.files import detect_format
from . import features  # noqa: F401  (registers its queries)
from . import synth as S
from .common import ORACLE_SQL, QUERIES  # noqa: F401
from .common import many_drawings as _many_drawings
from .common import query as _query
from .common import read as _read
from .common import table as _table
from .common import zipped as _zipped

c = F.col


def _order_lines(spark: SparkSession, sf_dir: str, end: Column | None = None, style: tuple = S.STYLE) -> list[DataFrame]:
    """Orders as two points and a line each."""
    o, k = _table(spark, sf_dir, "orders"), c("o_orderkey") * 3
    d = _many_drawings(c("o_orderkey"))
    points = S.rows(o, d, 61, 61, k, S.p(k + 1, c("o_totalprice"), 0), S.p(k + 2, c("o_custkey"), 1.5))
    lines = S.rows(o, d, 62, 62, k, S.lin(k + 3, k + 1, k + 2 if end is None else end, style))
    return [S.rows(o.select(d.alias("d")).distinct(), c("d"), 6, 6, F.lit(0), F.lit("Top\n")), points, lines]


def _part_circles(spark: SparkSession, sf_dir: str, center: tuple, rim: tuple) -> list[DataFrame]:
    t, k = _table(spark, sf_dir, "part"), c("p_partkey") * 3
    d = F.concat(F.lit("part-"), _many_drawings(c("p_partkey")).cast("string"))
    return [
        S.rows(t, d, 61, 61, k, S.p(k + 1, *center), S.p(k + 2, *rim)),
        S.rows(t, d, 62, 62, k, S.cir(k + 3, k + 1, k + 2)),
    ]


@_query("SELECT o_orderkey * 3 + 3 AS entity_id, o_totalprice AS x1, CAST(0 AS DOUBLE) AS y1, CAST(o_custkey AS DOUBLE) AS x2, CAST(1.5 AS DOUBLE) AS y2 FROM orders")
def q01_line_geometry(spark, sf_dir):
    lines = _read(spark, *_order_lines(spark, sf_dir)).lines_geo
    return lines.select("entity_id", c("start.x").alias("x1"), c("start.y").alias("y1"), c("end.x").alias("x2"), c("end.y").alias("y2"))


@_query("SELECT 'P' AS record_type, 2 * (SELECT count(*) FROM orders) + 2 * (SELECT count(*) FROM part) AS n UNION ALL SELECT 'LIN', count(*) FROM orders UNION ALL SELECT 'CIR', count(*) FROM part")
def q02_record_type_counts(spark, sf_dir):
    both = _read(spark, *_order_lines(spark, sf_dir), *_part_circles(spark, sf_dir, (0, 0), (1, 1)))
    return both.records.where("record_type is not null").groupBy("record_type").agg(F.count("*").alias("n"))


@_query("SELECT CAST(61 AS BIGINT) AS section_number, CAST(2 * ((SELECT count(*) FROM orders) + (SELECT count(*) FROM part)) AS BIGINT) AS n UNION ALL SELECT 62, (SELECT count(*) FROM orders) + (SELECT count(*) FROM part)")
def q03_section_records(spark, sf_dir):
    both = _read(spark, *_order_lines(spark, sf_dir), *_part_circles(spark, sf_dir, (0, 0), (1, 1)))
    return both.sections.where("record_count > 0 and number <> 6").groupBy(c("number").alias("section_number")).agg(F.sum("record_count").alias("n"))


@_query("""SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN count(*) + 2 ELSE 0 END AS lf, CASE conv_id % 3 WHEN 1 THEN count(*) + 2 ELSE 0 END AS crlf,
           CASE conv_id % 3 WHEN 2 THEN count(*) + 2 ELSE 0 END AS cr FROM conversations GROUP BY conv_id""")
def q04_newlines(spark, sf_dir):
    t = _table(spark, sf_dir, "conversations")
    kinds = []
    for i, newline in enumerate(("\n", "\r\n", "\r")):
        some = S.rows(t.where(c("conv_id") % 3 == i), c("conv_id"), 1, 1, c("turn"), F.lit("turn "), c("turn").cast("string"), F.lit("\n"))
        kinds.append(S.drawings(some, newline=newline))
    rows = corpus.read(spark, kinds[0].union(kinds[1]).union(kinds[2]), mode="FAILFAST")._drawings
    return rows.select(c(KEY).cast("bigint").alias("conv_id"), "newlines.lf", "newlines.crlf", "newlines.cr")


@_query("""SELECT CASE doc_id % 4 WHEN 1 THEN 'invalid' WHEN 2 THEN 'compressed_candidate' ELSE 'mi_text' END AS kind, CASE WHEN doc_id % 4 = 2 THEN 'gzip' ELSE '-' END AS compression,
           doc_id % 4 = 3 AS utf8_bom, count(*) AS n FROM documents GROUP BY ALL""")
def q05_format_detect(spark, sf_dir):
    t = _table(spark, sf_dir, "documents")
    body = F.encode("text", "UTF-8")
    start = [F.lit(b"#~1\n"), F.lit(b"plain "), F.unhex(F.lit("1F8B0800")), F.lit(b"\xef\xbb\xbf\r\n  #~7 \r\n")]
    made = F.when(c("doc_id") % 4 == 0, F.concat(start[0], body)).when(c("doc_id") % 4 == 1, F.concat(start[1], body)).when(c("doc_id") % 4 == 2, F.concat(start[2], body)).otherwise(F.concat(start[3], body))
    found = detect_format(t.select(made.alias("content")))
    return found.groupBy(F.coalesce("format.kind", F.lit("invalid")).alias("kind"), F.coalesce("format.compression", F.lit("-")).alias("compression"), F.coalesce("format.utf8_bom", F.lit(False)).alias("utf8_bom")).agg(F.count("*").alias("n"))


@_query("SELECT p_partkey, round(abs(p_retailprice), 6) AS radius FROM part")
def q06_circle_radius(spark, sf_dir):
    rows = _read(spark, *_part_circles(spark, sf_dir, (c("p_size"), 0), (c("p_size"), c("p_retailprice")))).circles
    return rows.select(F.floor((c("entity_id") - 3) / 3).alias("p_partkey"), F.round("radius", 6).alias("radius"))


@_query("""SELECT s_suppkey, CAST(s_suppkey + 1 AS DOUBLE) AS radius, round((s_suppkey % 4) * pi() / 2, 6) AS start_angle, round(((s_suppkey + 1) % 4) * pi() / 2, 6) AS end_angle FROM supplier""")
def q07_arc_angles(spark, sf_dir):
    t, k, r = _table(spark, sf_dir, "supplier"), c("s_suppkey") * 4, c("s_suppkey") + 1

    def axis(n: Column) -> tuple:
        n = n % 4
        return F.when(n == 0, r).when(n == 2, -r).otherwise(0), F.when(n == 1, r).when(n == 3, -r).otherwise(0)

    d = _many_drawings(c("s_suppkey"))
    parts = [
        S.rows(t, d, 61, 61, k, S.p(k + 1, 0, 0), S.p(k + 2, *axis(c("s_suppkey"))), S.p(k + 3, *axis(c("s_suppkey") + 1))),
        S.rows(t, d, 62, 62, k, S.arc(k + 4, k + 1, k + 2, k + 3)),
    ]
    return _read(spark, *parts).arcs.select(F.floor((c("entity_id") - 4) / 4).alias("s_suppkey"), "radius", F.round("start_angle", 6).alias("start_angle"), F.round("end_angle", 6).alias("end_angle"))


def _text_record(key, text) -> Column:
    matrix = (1, 0, 5, 0, 1, 7, 0, 0, 1)
    return S.record("TEX", key, *S.STYLE, 1, *matrix, 0, 0, "font", "other font", 0, 0, 2, 4, 0, 1.5, 0, 1, text, 0)


@_query("SELECT doc_id, md5(regexp_replace(text, '[\\r\\n]', ' ', 'g')) AS digest, CAST(4 AS DOUBLE) AS height FROM documents")
def q08_text_decode(spark, sf_dir):
    t = _table(spark, sf_dir, "documents")
    d = _many_drawings(c("doc_id"))
    body = S.rows(t, d, 62, 62, c("doc_id"), _text_record(c("doc_id") + 1, F.regexp_replace("text", "[\\r\\n]", " ")))
    texts = _read(spark, S.head(t, d, "3.20"), body).texts
    return texts.select((c("entity_id") - 1).alias("doc_id"), F.md5(c("text").cast("binary")).alias("digest"), "height")


@_query("""SELECT CASE doc_id % 5 WHEN 0 THEN 'utf8_bom' WHEN 1 THEN 'mi_version' WHEN 2 THEN 'declared' WHEN 3 THEN 'declared' ELSE 'ascii_only' END AS source,
           CASE WHEN doc_id % 5 <= 2 THEN 'utf-8' ELSE '-' END AS name, count(*) AS n FROM documents GROUP BY ALL""")
def q09_encoding_detect(spark, sf_dir):
    t = _table(spark, sf_dir, "documents")
    of = lambda i: t.where(c("doc_id") % 5 == i)
    declared = lambda i, label: S.rows(of(i), c("doc_id"), -3, 1, F.lit(0), F.lit(f"ENCODING: {label}\n"))
    made = [
        S.drawings(S.head(of(0), c("doc_id")), mark=b"\xef\xbb\xbf"), S.drawings(S.head(of(1), c("doc_id"), "3.20")), S.drawings(declared(2, "Unicode"), S.head(of(2), c("doc_id"), "3.4")),
        S.drawings(declared(3, "martian"), S.head(of(3), c("doc_id"))), S.drawings(S.head(of(4), c("doc_id"))),
    ]
    total = made[0]
    for more in made[1:]:
        total = total.union(more)
    rows = corpus.read(spark, total, mode="FAILFAST")._drawings
    return rows.groupBy("encoding.source", F.coalesce("encoding.name", F.lit("-")).alias("name")).agg(F.count("*").alias("n"))


@_query("SELECT event_type AS layer, count(*) AS n FROM events GROUP BY event_type")
def q10_layers(spark, sf_dir):
    t = _table(spark, sf_dir, "events")
    d, k = _many_drawings(c("event_id")), c("event_id") * 3 + 2000000
    # Each drawing numbers its own types.
    each = t.select(d.alias("d"), "event_type").distinct().withColumn("prop", F.row_number().over(Window.partitionBy("d").orderBy("event_type")).cast("bigint"))
    rows = t.withColumn("d", d).join(each, ["d", "event_type"])
    d = c("d")
    parts = [
        S.rows(each, c("d"), 42, 42, c("prop"), S.assp(c("prop"), F.concat(F.lit("LAYER: "), c("event_type")))),
        S.rows(rows, d, 61, 61, k, S.p(k + 1, 0, 0), S.p(k + 2, 1, c("value"))),
        S.rows(rows, d, 62, 62, k, S.lin(k + 3, k + 1, k + 2, (1, 0, 0, 1, c("prop")))),
    ]
    return _read(spark, *parts).layers.groupBy("layer").agg(F.count("*").alias("n"))


@_query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def q11_query_alias(spark, sf_dir):
    t, k = _table(spark, sf_dir, "orders"), c("o_orderkey") * 3
    d = _many_drawings(c("o_orderkey"))
    parts = [
        S.rows(t, d, 61, 61, k, S.p(k + 1, 0, 0), S.p(k + 2, 1, 1)),
        S.rows(t, d, 62, 62, k, F.when(c("o_orderstatus") == "F", S.cir(k + 3, k + 1, k + 2)).otherwise(S.lin(k + 3, k + 1, k + 2))),
    ]
    return _read(spark, *parts).query("circle, spline").select(F.floor((c("entity_id") - 3) / 3).alias("o_orderkey"))


@_query("SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def q12_part_ownership(spark, sf_dir):
    n, s = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "supplier")
    d = _many_drawings(c("s_suppkey"))
    # A nation has a part in the drawing of each thousand suppliers that it has some of, and one in a drawing of nations alone.
    seen = s.select(d.alias("d"), c("s_nationkey").alias("n_nationkey")).distinct().join(n, "n_nationkey").select("d", "n_nationkey", "n_name")
    each = seen.unionByName(n.select((-1 - _many_drawings(c("n_nationkey"))).alias("d"), "n_nationkey", "n_name"))
    parts = [
        S.rows(each, c("d"), c("n_nationkey") * 2, 6, F.lit(0), c("n_name"), F.lit("\n")),
        S.rows(s, d, c("s_nationkey") * 2 + 1, 61, c("s_suppkey"), S.p(c("s_suppkey") + 1, c("s_acctbal"), 0)),
    ]
    return _read(spark, *parts).parts.groupBy(c("name").alias("n_name")).agg(F.sum(F.size("point_ids")).alias("n"))


def _atlas(spark: SparkSession, sf_dir: str) -> corpus.Corpus:
    """A top part that places regions as sheets, which place nations; a line in each nation."""
    r, n = _table(spark, sf_dir, "region"), _table(spark, sf_dir, "nation")
    d = F.lit("atlas")
    one = spark.range(1)
    regions = F.transform(F.array_sort(F.collect_list(c("r_regionkey"))), lambda k: S.child(100 + k, k * 100, 0, (1,)))
    nations = F.transform(F.array_sort(F.collect_list(c("n_nationkey"))), lambda k: S.child(1000 + k, 0, k))
    top = r.agg(regions.alias("children"))
    inner = n.groupBy("n_regionkey").agg(nations.alias("children")).join(r, c("n_regionkey") == c("r_regionkey"))
    at = c("n_nationkey") * 3
    return _read(
        spark,
        S.rows(one, d, 42, 42, F.lit(0), S.assp(1, "DOCU_SHEET")),
        S.rows(top, d, 50, 5, F.lit(0), S.asse(10, "Top", c("children"))),
        S.rows(inner, d, 50, 5, 1 + c("r_regionkey"), S.asse(100 + c("r_regionkey"), c("r_name"), c("children"), 1)),
        S.rows(n, d, 50, 5, 1000 + c("n_nationkey"), S.asse(1000 + c("n_nationkey"), c("n_name"))),
        S.rows(one, d, 100, 6, F.lit(0), F.lit("Top\n")),
        S.rows(r, d, 200 + c("r_regionkey"), 6, F.lit(0), c("r_name"), F.lit("\n")),
        S.rows(n, d, 1000 + at, 6, F.lit(0), c("n_name"), F.lit("\n")),
        S.rows(n, d, 1001 + at, 61, F.lit(0), S.p(10001 + at, 0, 0), S.p(10002 + at, c("n_nationkey") + 1, 2)),
        S.rows(n, d, 1002 + at, 62, F.lit(0), S.lin(10003 + at, 10001 + at, 10002 + at)),
    )


@_query("""SELECT n_name AS name, CAST(2 AS INTEGER) AS depth, false AS is_sheet, r_regionkey * CAST(100 AS DOUBLE) AS tx, CAST(n_nationkey AS DOUBLE) AS ty FROM nation JOIN region ON n_regionkey = r_regionkey
           UNION ALL SELECT r_name, 1, true, r_regionkey * CAST(100 AS DOUBLE), CAST(0 AS DOUBLE) FROM region""")
def q13_occurrences(spark, sf_dir):
    atlas = _atlas(spark, sf_dir)
    rows = atlas.occurrences(include_root=False).join(atlas.part_names.select(KEY, "part_index", "name"), [KEY, "part_index"])
    return rows.select("name", "depth", "is_sheet", c("world.tx").alias("tx"), c("world.ty").alias("ty"))


@_query("""SELECT CAST(10003 + n_nationkey * 3 AS BIGINT) AS entity_id, r_regionkey * CAST(100 AS DOUBLE) AS x1, CAST(n_nationkey AS DOUBLE) AS y1, r_regionkey * CAST(100 AS DOUBLE) + n_nationkey + 1 AS x2,
           CAST(n_nationkey + 2 AS DOUBLE) AS y2 FROM nation JOIN region ON n_regionkey = r_regionkey""")
def q14_placed_graphics(spark, sf_dir):
    return _atlas(spark, sf_dir).placed_lines().select("entity_id", c("start.x").alias("x1"), c("start.y").alias("y1"), c("end.x").alias("x2"), c("end.y").alias("y2"))


@_query("""SELECT p_partkey, i, round(p_partkey + p_size * cos(2 * pi() * i / 8), 6) + 0.0 AS x, round(p_size * sin(2 * pi() * i / 8), 6) + 0.0 AS y
           FROM part, generate_series(0, 8) AS g(i)""")
def q15_polyline_circle(spark, sf_dir):
    rows = _read(spark, *_part_circles(spark, sf_dir, (c("p_partkey"), 0), (c("p_partkey") + c("p_size"), 0))).polylines(8)
    flat = rows.select(F.floor((c("entity_id") - 3) / 3).alias("p_partkey"), F.posexplode("vertices").alias("i", "v"))
    return flat.select("p_partkey", c("i").cast("bigint").alias("i"), (F.round("v.x", 6) + 0.0).alias("x"), (F.round("v.y", 6) + 0.0).alias("y"))


@_query("""SELECT vec_id, i, round(CASE WHEN i % 2 = 0 THEN CAST(embedding[i // 2 + 1] AS DOUBLE) ELSE (CAST(embedding[i // 2 + 1] AS DOUBLE) + CAST(embedding[i // 2 + 2] AS DOUBLE)) / 2 END, 6) + 0.0 AS y
           FROM embeddings, generate_series(0, 126) AS g(i)""")
def q16_bspline_eval(spark, sf_dir):
    t, d = _table(spark, sf_dir, "embeddings"), _many_drawings(c("vec_id"))
    k = c("vec_id") * 100
    controls = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (k + i).cast("string"))
    knots = ["0", *map(str, range(64)), "63"]
    # Doubles of the 32-bit values in full, so both sides read the same number.
    points = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: S.p(k + i + 1, i, F.get("embedding", i).cast("double"))), "")
    spline = S.record("BSPL", k + 99, *S.STYLE, 2, 0, 0, 63, k + 1, k + 64, 64, S.many(controls), len(knots), *knots, 0)
    parts = [S.rows(t, d, 61, 61, k, points), S.rows(t, d, 62, 62, k, spline)]
    rows = _read(spark, *parts).polylines(126)
    flat = rows.select(F.floor(c("entity_id") / 100).alias("vec_id"), F.posexplode("vertices").alias("i", "v"))
    return flat.select("vec_id", c("i").cast("bigint").alias("i"), (F.round("v.y", 6) + 0.0).alias("y"))


def _codes(diagnostics: DataFrame, *codes: str) -> DataFrame:
    return diagnostics.where(c("code").isin(*codes)).groupBy("code").agg(F.count("*").alias("n"))


@_query("SELECT 'MI_DANGLING_POINT_REFERENCE' AS code, count(*) AS n FROM orders WHERE o_orderkey % 7 = 0")
def q17_dangling_refs(spark, sf_dir):
    k = c("o_orderkey") * 3
    rows = _read(spark, *_order_lines(spark, sf_dir, F.when(c("o_orderkey") % 7 == 0, k + 900000000).otherwise(k + 2)))
    return _codes(rows.diagnostics, "MI_DANGLING_POINT_REFERENCE", "MI_REFERENCE_TYPE_MISMATCH")


def _property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property in each drawing of orders."""
    each = _table(spark, sf_dir, "orders").select(_many_drawings(c("o_orderkey")).alias("id")).distinct()
    return S.rows(each, c("id"), 41, 41, F.lit(0), S.record("PSTAT", 999999999, 0, 1))


@_query("SELECT 'MI_REFERENCE_TYPE_MISMATCH' AS code, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0")
def q18_type_mismatch(spark, sf_dir):
    k = c("o_orderkey") * 3
    rows = _read(spark, _property(spark, sf_dir), *_order_lines(spark, sf_dir, F.when(c("o_orderkey") % 5 == 0, 999999999).otherwise(k + 2)))
    return _codes(rows.diagnostics, "MI_DANGLING_POINT_REFERENCE", "MI_REFERENCE_TYPE_MISMATCH")


@_query("SELECT user_id, arg_min(value, event_id) AS x, count(*) - 1 AS repeats FROM events GROUP BY user_id")
def q19_duplicate_ids(spark, sf_dir):
    t = _table(spark, sf_dir, "events")
    rows = _read(spark, S.rows(t, _many_drawings(c("user_id")), 61, 61, c("event_id"), S.p(c("user_id") + 1, c("value"), 0)))
    each = rows.points.groupBy("entity_id").agg(F.max(F.when(c("is_first"), c("x"))).alias("x"), (F.count("*") - 1).alias("repeats"))
    return each.select((c("entity_id") - 1).alias("user_id"), "x", "repeats")


@_query("SELECT CASE WHEN c_acctbal < 0 THEN 'unsupported' ELSE 'point' END AS kind, count(*) AS n FROM customer GROUP BY ALL")
def q20_invalid_records(spark, sf_dir):
    t = _table(spark, sf_dir, "customer")
    rows = _read(spark, S.rows(t, _many_drawings(c("c_custkey")), 61, 61, c("c_custkey"), S.p(c("c_custkey") + 1, F.when(c("c_acctbal") < 0, "NaN").otherwise(c("c_acctbal").cast("string")), 0)))
    return rows.entities.groupBy("kind").agg(F.count("*").alias("n"))


@_query("SELECT o_orderkey // 1000 AS drawing, (o_orderkey // 1000) % 2 = 1 AS mismatch FROM orders GROUP BY ALL")
def q21_toc_check(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    d = _many_drawings(c("o_orderkey"))
    rows = _read(spark, S.head(o, d, last=c("o_orderkey") * 3 + 3 + d % 2), *_order_lines(spark, sf_dir))
    wrong = rows.diagnostics.where("code = 'MI_TOC_LAST_MISMATCH'").select(KEY, F.lit(True).alias("wrong"))
    return rows._drawings.join(wrong, KEY, "left").select(c(KEY).cast("bigint").alias("drawing"), F.coalesce("wrong", F.lit(False)).alias("mismatch"))


@_query("SELECT p_partkey, CAST(1 + p_size % 3 AS INTEGER) AS loops, CAST(p_size AS DOUBLE) AS spacing FROM part")
def q22_hatch_boundaries(spark, sf_dir):
    t, k = _table(spark, sf_dir, "part"), c("p_partkey") * 10
    inner = c("p_size") % 3
    d = _many_drawings(c("p_partkey"))
    loop = lambda i: S.record("COC", k + i, *S.STYLE, 1, 0, 1, k + 8)
    ids = F.when(inner > 0, F.transform(F.sequence(F.lit(0), F.greatest(inner - 1, F.lit(0))), lambda i: (k + 3 + i).cast("string"))).otherwise(F.array().cast("array<string>"))
    hatch = S.record("HAT", k + 1, *S.STYLE, 0, 0, 0.5, c("p_size"))
    wrong, right = S.record("PFA", k + 6, 0, k + 1, k + 2, 0), S.record("PFA", k + 9, 0, k + 1, k + 2, inner, S.many(ids))
    rows = _read(spark, S.rows(t, d, 72, 72, k, hatch, loop(2), loop(3), loop(4), wrong, right)).hatches
    return rows.select(F.floor((c("entity_id") - 1) / 10).alias("p_partkey"), F.size("boundary_loop_ids").alias("loops"), "spacing")


@_query("SELECT s_suppkey, s_acctbal AS measurement, CAST(s_suppkey AS DOUBLE) AS upper_value, 'len ' || s_suppkey AS label FROM supplier")
def q23_dimension_refs(spark, sf_dir):
    t, k = _table(spark, sf_dir, "supplier"), c("s_suppkey") * 10 + 1000
    d = _many_drawings(c("s_suppkey"))
    label = F.concat(F.lit("len "), c("s_suppkey").cast("string"))
    body: list = [0] * 70
    body[7], body[8], body[20], body[21], body[30], body[31] = 1.5, 2.5, c("s_acctbal"), label, k + 2, k + 2
    parts = [
        S.rows(t, d, 42, 42, k, S.record("DTV", k + 2, 1, c("s_suppkey"), -1, 0, "up", "down", 0, 5)),
        S.rows(t, d, 71, 71, k, S.record("DSGL", k + 1, 0, *body)),
    ]
    rows = _read(spark, *parts)
    dims = rows.dimensions.select(KEY, "measurement", c("formatted_text.text").alias("label"), "entity_id", F.explode("tolerance_ids").alias("t"))
    tols = rows.tolerances.select(KEY, c("entity_id").alias("t"), "upper_value")
    return dims.join(tols, [KEY, "t"]).select(F.floor((c("entity_id") - 1001) / 10).alias("s_suppkey"), "measurement", "upper_value", "label")


@_query("""SELECT ['black', 'red', 'green', 'yellow', 'blue', 'magenta', 'cyan', 'white'][o_orderkey % 8 + 1] AS value, count(*) AS n FROM orders GROUP BY ALL""")
def q24_audit_styles(spark, sf_dir):
    rows = _read(spark, *_order_lines(spark, sf_dir, style=(c("o_orderkey") % 8, 0, 0.5, 9, 0)))
    return rows.audit().where("metric = 'color_names'").select("value", c("count").alias("n"))


@_query("""SELECT c_custkey, CAST(1 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS c, CAST(1 AS DOUBLE) AS d, CAST(0 AS DOUBLE) AS tx, CAST(0 AS DOUBLE) AS ty FROM customer""")
def q25_affine_inverse(spark, sf_dir):
    t = _table(spark, sf_dir, "customer")
    turn = F.radians(c("c_custkey") % 360)
    m = G.affine(F.cos(turn), F.sin(turn), -F.sin(turn), F.cos(turn), c("c_acctbal") / 100, c("c_custkey") / 7)
    back = t.select("c_custkey", m.alias("m")).select("c_custkey", "m", G.inverse(c("m")).alias("i")).select("c_custkey", G.compose(c("i"), c("m")).alias("e"))
    return back.select("c_custkey", *[(F.round(f"e.{n}", 6) + 0.0).alias(n) for n in G.AFFINE])


@_query("SELECT CAST(0 AS BIGINT) AS differing, count(*) AS n, 'gzip' AS compression FROM orders")
def q26_gzip_equivalence(spark, sf_dir):
    plain = S.drawings(*_order_lines(spark, sf_dir))
    a, b = corpus.read(spark, plain, mode="FAILFAST"), corpus.read(spark, _zipped(plain), mode="FAILFAST")
    x, y = (r.lines_geo.select(KEY, "entity_id", "start", "end") for r in (a, b))
    # One exchange tells both sides' rows apart: a row that both have as often counts to zero.
    both = x.withColumn("w", F.lit(1)).unionByName(y.withColumn("w", F.lit(-1)))
    odd = both.groupBy(*x.columns).agg(F.abs(F.sum("w")).alias("o"), F.sum(F.when(c("w") < 0, 1).otherwise(0)).alias("y"))
    facts = odd.select("o", "y", F.lit(None).cast("string").alias("k")).unionAll(b._drawings.select(F.lit(0), F.lit(0), "format.compression"))
    return facts.agg(F.sum("o").alias("differing"), F.sum("y").alias("n"), F.max("k").alias("compression"))


@_query("SELECT 'Top' AS name, true AS is_top, CAST(1 AS INTEGER) AS n_roots, CAST(5 AS INTEGER) AS n_children")
def q27_roots_and_top(spark, sf_dir):
    atlas = _atlas(spark, sf_dir)
    parts = atlas.parts.join(atlas.roots, KEY)
    rows = parts.where(F.array_contains("root_part_indices", c("part_index")))
    return rows.select("name", (c("part_index") == c("top_part_index")).alias("is_top"), F.size("root_part_indices").alias("n_roots"), F.size("child_part_indices").alias("n_children"))


@_query("""SELECT 'MI_DANGLING_POINT_REFERENCE' AS code, count(*) AS n FROM orders WHERE o_orderkey % 7 = 0
           UNION ALL SELECT 'MI_REFERENCE_TYPE_MISMATCH', count(*) FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0
           UNION ALL SELECT 'MI_MISSING_GLOBAL_SECTION', count(*) FROM (SELECT o_orderkey // 1000 FROM orders UNION SELECT c_custkey // 1000 FROM customer)
           UNION ALL SELECT 'MI_UNSUPPORTED_ENTITY', count(*) FROM customer UNION ALL SELECT 'MI_INVALID_ENTITY_RECORD', count(*) FROM customer WHERE c_acctbal < 0
           UNION ALL SELECT 'MI_DUPLICATE_ENTITY_ID', 2 * count(*) FROM customer""")
def q28_diagnostic_histogram(spark, sf_dir):
    k = c("o_orderkey") * 3
    t, key = _table(spark, sf_dir, "customer"), c("c_custkey") + 500000000
    d = _many_drawings(c("c_custkey"))
    odd = S.rows(t, d, 71, 71, key, S.record("MYSTERY", key, "x"), S.record("P", key, F.when(c("c_acctbal") < 0, "1.0d").otherwise("1"), 0), S.record("P", key, "+2", "1e0"))
    rows = _read(spark, _property(spark, sf_dir), odd, *_order_lines(spark, sf_dir, F.when(c("o_orderkey") % 7 == 0, k + 900000000).when(c("o_orderkey") % 5 == 0, 999999999).otherwise(k + 2)))
    return rows.diagnostics.groupBy("code").agg(F.count("*").alias("n"))


@_query("SELECT o_orderkey, i, CAST(o_custkey + i AS DOUBLE) AS x, CAST(i AS DOUBLE) AS y FROM orders, generate_series(0, 3) AS g(i) WHERE i <= o_orderkey % 4")
def q29_leader_vertices(spark, sf_dir):
    t = _table(spark, sf_dir, "orders")
    n = c("o_orderkey") % 4
    vertices = F.flatten(F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: F.array((c("o_custkey") + i).cast("string"), i.cast("string"), F.lit("0"))))
    rows = _read(spark, S.rows(t, _many_drawings(c("o_orderkey")), 71, 71, c("o_orderkey"), S.record("LED", c("o_orderkey") + 1, *S.STYLE, 2, 3.5, n + 1, S.many(vertices)))).leaders
    flat = rows.select((c("entity_id") - 1).alias("o_orderkey"), F.posexplode("points").alias("i", "p"))
    return flat.select("o_orderkey", c("i").cast("bigint").alias("i"), c("p.x").alias("x"), c("p.y").alias("y"))


@_query("SELECT s_suppkey, CAST(s_suppkey * 10 + i AS BIGINT) AS component, i = 1 AS resolved FROM supplier, generate_series(1, 3) AS g(i)")
def q30_symbol_components(spark, sf_dir):
    t, k = _table(spark, sf_dir, "supplier"), c("s_suppkey") * 10
    d = _many_drawings(c("s_suppkey"))
    rows = _read(spark, S.rows(t, d, 62, 62, k, S.lin(k + 1, k + 5, k + 6)), S.rows(t, d, 82, 82, k, S.record("SYML", k + 9, k + 1, k + 2, k + 3)))
    found = rows.references.where("role = 'symbol component'")
    return found.select(F.floor((c("entity_id") - 9) / 10).alias("s_suppkey"), c("target").alias("component"), (c("status") == "ok").alias("resolved"))
