"""Typed decoding of framed records, in Column expressions.

Records are positional and their layout depends on counts inside them. Each type states where its
content starts and which readings must succeed; a record that fails stays as kind "unsupported" with
its fields. Decoding is one narrow pass over the records without a shuffle; only the children of assemblies,
whose places depend on all before them, are read by a walk in Python.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.strict import Fields, let, number, real, signed, trimmed, whole

#: Record types by kind.
KINDS = {
    "point": ("P",), "line": ("LIN",), "arc": ("ARC",), "fillet": ("FIL",), "bspline": ("BSPL",), "circle": ("CIR",), "text": ("TEX",),
    "property": ("PSTAT", "ASSP", "DTA", "DTF", "DLA", "DDA", "DAF", "HAPP"), "tolerance": ("DTV",), "leader": ("LED",), "contour": ("COC",), "hatch": ("HAT",),
    "hatch_assoc": ("PFA",), "symbol": ("SYML",), "dimension": ("DANG", "DCHMF", "DDIA", "DRAD", "DSGL"), "assembly": ("ASSE",),
}
GRAPHIC_KINDS = ("line", "arc", "fillet", "bspline", "circle", "text")
ANNOTATION_KINDS = ("dimension", "tolerance", "leader", "hatch", "symbol")
#: Fixed values of the dimension layouts: least fields, and places after the property list of geometry ids, point ids, text position and measurement.
DIMENSIONS = {
    "DANG": (75, (0, 2), (1, 3), 5, 18),
    "DCHMF": (63, (0, 2, 5), (1, 3), 8, 21),
    "DDIA": (64, (0,), (), 2, 15),
    "DRAD": (56, (0,), (), 2, 15),
    "DSGL": (73, (0, 2), (1, 3), 7, 20),
}
#: Last place at which a spline's layout may start, and its highest order.
SPLINE_START, SPLINE_ORDER = 64, 16

f = Fields("fields")


class _Type:
    """The record type; columns are only made when a session exists."""

    def isin(self, *names: str) -> Column:
        return F.col("record_type").isin(*names)

    def __eq__(self, name: str) -> Column:
        return F.col("record_type") == name

    __hash__ = None


TYPE = _Type()


def text_value(i) -> Column:
    """(raw_bytes, text) of a text field."""
    at = i if isinstance(i, Column) else F.lit(i)
    return F.struct(F.encode(F.get("fields", at), "ISO-8859-1").alias("raw_bytes"), F.get("texts", at).alias("text"))


def _all(*parts: Column) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return F.coalesce(out, F.lit(False))


def _ok(*values: Column) -> Column:
    return _all(*[v.isNotNull() for v in values])


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _only(found: Column) -> Column:
    """The element of an array that has exactly one."""
    return let(found, lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0))))


def _starts() -> Column:
    """Both places at which content can start."""
    return F.array_distinct(F.array_compact(F.array(F.col("legacy__"), F.col("modern__"))))


def content_starts() -> dict[tuple[str, ...], Column]:
    """By record types: where the content of a graphic or annotation record starts; null if no single layout fits."""
    n = f.size

    def text_fits(start: Column, lines_at: int) -> Column:
        at = start + lines_at
        return let(
            f.count(at),
            lambda k: (f.u(start).between(1, 9)) & (k > 0) & (at + 1 + 2 * k == n) & F.forall(F.sequence(F.lit(0), k - 1), lambda j: F.coalesce(signed(F.get(f.array, at + 2 + 2 * j)) == 0, F.lit(False))),
        )

    legacy, modern = F.col("legacy__"), F.col("modern__")
    text = F.when(n >= 30, _only(F.array_compact(F.array(F.when(text_fits(legacy, 20), legacy * 2), F.when(text_fits(modern, 21), modern * 2 + 1)))))
    leader = _only(F.filter(_starts(), lambda s: F.coalesce(let(f.count(s + 2), lambda k: (k > 0) & (s + 3 + 3 * k == n)), F.lit(False))))
    contour = _only(F.filter(_starts(), lambda s: F.coalesce(let(f.count(s + 2), lambda k: (k > 0) & (s + 3 + k == n)), F.lit(False))))
    hatch = _only(F.filter(_starts(), lambda s: s + 4 == n))
    return {
        ("LIN", "CIR"): F.when(n >= 9, n - 2),
        ("ARC", "FIL"): F.when((n >= 11) & ((n == 11) | (n >= 17)), n - 4),
        ("BSPL",): _only(_spline_starts()),
        ("TEX",): text,
        ("LED",): leader,
        ("COC",): contour,
        ("HAT",): hatch,
    }


def _spline_starts() -> Column:
    n = f.size

    def fits(s: Column) -> Column:
        order, controls = f.u(s), f.count(s + 6)
        head = (order.between(1, SPLINE_ORDER)) & f.i(s + 1).isNotNull() & f.i(s + 2).isNotNull() & f.f(s + 3).isNotNull() & f.u(s + 4).isNotNull() & f.u(s + 5).isNotNull() & (controls >= order)

        def rest(c: Column) -> Column:
            knots_at = s + 8 + c
            knots = c + order.cast("int")

            def samples(m: Column) -> Column:
                start = knots_at + knots + 1
                pure = F.transform(F.sequence(F.lit(0), m), lambda j: F.when(j == m, F.lit(True)).otherwise(F.forall(f.fs(start + 7 * j, 7), lambda v: v.isNotNull()) & f.u(start + 7 * j).isNotNull()))
                return (start + 7 * m == n) & F.forall(pure, lambda v: v)

            values = f.fs(knots_at, knots)
            rising = let(values, lambda v: (F.size(v) == knots) & whole(v) & F.forall(F.zip_with(v, F.slice(v, 2, F.greatest(F.size(v), F.lit(1))), lambda a, b: b.isNull() | (a <= b)), lambda x: x))
            return (F.size(f.us(s + 7, c)) == c) & whole(f.us(s + 7, c)) & (f.count(s + 7 + c) == knots) & rising & let(f.count(knots_at + knots), samples)

        return F.coalesce(F.when(head, let(controls, rest)), F.lit(False))

    last = F.least(n - 9, F.lit(SPLINE_START))
    return F.when((n >= 16) & (last >= 2), F.filter(F.sequence(F.lit(2), F.greatest(last, F.lit(2))), fits))


def graphic_header() -> Column:
    """Style and properties of a record whose content starts at ``start``; null if no single header ends there."""
    start = F.col("start")
    legacy = F.coalesce(F.col("legacy__") == start, F.lit(False))
    modern = F.coalesce(F.col("modern__") == start, F.lit(False))
    first = F.when(legacy, 6).otherwise(7)
    ids = f.us(first, start - first)
    good = _all(legacy != modern, _ok(f.i(2), f.i(3), f.f(4)), F.when(legacy, f.i(4).isNotNull()).otherwise(f.i(5).isNotNull()), F.size(ids) == start - first, whole(ids))
    return F.when(
        good,
        F.struct(
            f.i(2).alias("color"), f.i(3).alias("linetype"), f.f(4).alias("lineweight"), F.when(modern, f.i(5)).alias("visibility_value"), F.lit(None).cast("boolean").alias("visibility"),
            F.filter(ids, lambda x: x != 0).alias("property_ids"), F.when(legacy, "legacy").otherwise("modern").alias("layout"),
        ),
    )


def _values() -> Column:
    return f.slice(2, f.size).alias("field_values")


def point() -> Column:
    return F.when((TYPE == "P") & (f.size >= 4) & _ok(f.f(2), f.f(3)), _point(f.f(2), f.f(3)))


def line() -> Column:
    s = F.col("start")
    return F.when((TYPE == "LIN") & _ok(F.col("graphic"), f.u(s), f.u(s + 1)), F.struct(f.u(s).alias("start_id"), f.u(s + 1).alias("end_id")))


def circle() -> Column:
    s = F.col("start")
    return F.when((TYPE == "CIR") & _ok(F.col("graphic"), f.u(s), f.u(s + 1)), F.struct(f.u(s).alias("center_id"), f.u(s + 1).alias("circumference_id")))


def arc() -> Column:
    """ARC and FIL. A header that cannot be read fails only the short layout."""
    s = F.col("start")
    good = _ok(f.u(s), f.u(s + 1), f.u(s + 2), f.i(s + 3)) & ((s != 7) | F.col("graphic").isNotNull())
    return F.when(
        TYPE.isin("ARC", "FIL") & good,
        F.struct(f.u(s).alias("center_id"), f.u(s + 1).alias("start_id"), f.u(s + 2).alias("end_id"), f.i(s + 3).alias("orientation"), F.when(f.i(s + 3) == 0, True).alias("ccw"), f.slice(2, s - 2).alias("prefix_values")),
    )


def bspline() -> Column:
    s = F.col("start")
    order, controls = f.u(s).cast("int"), f.count(s + 6)
    knots_at = s + 8 + controls
    samples_at = knots_at + controls + order + 1
    m = f.count(samples_at - 1)

    def sample(j: Column) -> Column:
        at = samples_at + 7 * j
        return F.struct(f.u(at).alias("point_id"), f.f(at + 1).alias("parameter"), f.fs(at + 2, 5).alias("definition_values"))

    samples = F.when(m > 0, F.transform(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))), sample)).otherwise(F.slice(F.array(sample(F.lit(0))), 1, 0))
    return F.when(
        (TYPE == "BSPL") & s.isNotNull() & F.col("graphic").isNotNull(),
        F.struct(
            order.alias("order"), (order - 1).alias("degree"), f.slice(s + 1, 2).alias("definition_values"), f.f(s + 3).alias("parameter_max"), f.u(s + 4).alias("start_id"), f.u(s + 5).alias("end_id"),
            f.us(s + 7, controls).alias("control_point_ids"), f.fs(knots_at, controls + order).alias("knots"), samples.alias("samples"), f.slice(2, s - 2).alias("prefix_values"),
            *[F.lit(None).cast("boolean").alias(n) for n in ("closed", "periodic", "rational")], F.lit(None).cast("array<double>").alias("weights"), _values(),
        ),
    )


def _alignment(code: Column) -> tuple[Column, Column]:
    """Names of an alignment from 1 to 9: across, then from the bottom up."""
    across, up = F.array(*map(F.lit, ("left", "center", "right"))), F.array(*map(F.lit, ("lower", "middle", "upper")))
    return F.get(across, ((code - 1) % 3).cast("int")), F.get(up, F.floor((code - 1) / 3).cast("int"))


def _text_places() -> tuple[Column, Column, Column]:
    """Where a TEX's content starts, whether its layout is modern, and how far that moves its last fields; ``start0`` is doubled, and odd for the modern layout."""
    modern = F.col("start0") % 2 == 1
    return (F.col("start0") / 2).cast("int"), modern, F.when(modern, 1).otherwise(0)


def text_readings() -> dict[str, Column]:
    """What text() reads of a TEX many times."""
    s, _, shift = _text_places()
    count = f.count(s + 20 + shift)
    lines = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda j: text_value(s + 21 + shift + 2 * j))
    made = {"align__": f.u(s), "matrix__": f.fs(s + 1, 9), "sizes__": f.fs(s + 15 + shift, 2), "spacing__": f.f(s + 18 + shift), "lines__": lines}
    return {name: F.when(TYPE == "TEX", value) for name, value in made.items()}


def text() -> Column:
    """TEX, from text_readings()."""
    s, modern, _ = _text_places()
    matrix, sizes, lines, spacing = (F.col(n) for n in ("matrix__", "sizes__", "lines__", "spacing__"))
    near = lambda i, to: F.abs(F.get(matrix, F.lit(i)) - to) <= 1e-12
    good = _all(
        F.col("graphic").isNotNull(), F.size(matrix) == 9, whole(matrix), near(6, 0.0), near(7, 0.0), near(8, 1.0), F.size(sizes) == 2, whole(sizes), F.forall(sizes, lambda v: v > 0), spacing.isNotNull()
    )
    align = F.col("align__")
    h, v = _alignment(align)
    m = lambda i: F.get(matrix, F.lit(i))
    det = m(0) * m(4) - m(1) * m(3)
    return F.when(
        (TYPE == "TEX") & good,
        F.struct(
            align.alias("alignment"), h.alias("horizontal"), v.alias("vertical"),
            matrix.alias("transform_values"), _point(m(2), m(5)).alias("origin"), F.pmod(F.atan2(m(3), m(0)), F.lit(2 * math.pi)).alias("rotation"), (F.get(sizes, F.lit(0)) / F.get(sizes, F.lit(1))).alias("width_factor"), (det < 0).alias("mirrored"),
            text_value(s + 12).alias("font_name"), F.when(modern, text_value(s + 13)).alias("alternate_font_name"), sizes.alias("size_values"), F.get(sizes, F.lit(1)).alias("height"),
            spacing.alias("line_spacing"), lines.alias("lines"), F.get(lines, F.lit(0)).alias("content"),
            F.when(~F.exists(lines, lambda x: x.text.isNull()), F.array_join(F.transform(lines, lambda x: x.text), "\n")).alias("text"), _values(),
        ),
    )


def property_() -> Column:
    k = f.count(2)
    counted = _all(k + 3 == f.size)
    status = F.when(TYPE == "PSTAT", F.struct(f.b(2).alias("shared"), f.b(3).alias("scale_modifiable")))
    strings = F.when((TYPE == "ASSP") & (k > 0), F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda j: text_value(j + 3)))
    dta = F.when(TYPE == "DTA", F.struct(text_value(3).alias("font_name"), text_value(4).alias("alternate_font_name"), text_value(5).alias("symbol_font_name"), f.fs(6, f.size).alias("definition_values")))
    ints = F.when(TYPE.isin("DTF", "DDA"), f.is_(3, f.size))
    nums = F.when(TYPE.isin("DLA", "DAF"), f.fs(3, f.size))

    def pattern(j: Column) -> Column:
        at = 3 + 5 * j
        return F.struct(f.f(at).alias("offset"), f.f(at + 1).alias("distance"), f.f(at + 2).alias("angle"), f.i(at + 3).alias("color"), f.i(at + 4).alias("linetype"))

    happ = F.when((TYPE == "HAPP") & (k > 0), F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), pattern))
    good = (
        F.when(TYPE == "PSTAT", _all(f.size == 4, _ok(f.b(2), f.b(3))))
        .when(TYPE == "ASSP", counted)
        .when(TYPE == "DTA", counted & _all(k >= 3, whole(f.fs(6, f.size))))
        .when(TYPE.isin("DTF", "DDA"), counted & _all(whole(f.is_(3, f.size))))
        .when(TYPE.isin("DLA", "DAF"), counted & _all(whole(f.fs(3, f.size))))
        .when(TYPE == "HAPP", _all(3 + 5 * k == f.size) & ((k == 0) | _all(F.forall(happ, lambda p: p.offset.isNotNull() & p.distance.isNotNull() & p.angle.isNotNull() & p.color.isNotNull() & p.linetype.isNotNull()))))
    )
    layers = F.array_distinct(F.filter(F.transform(strings, lambda v: F.when(v.text.startswith("LAYER:"), trimmed(F.substring(v.text, 7, 1 << 30)))), lambda v: v != ""))
    sheet = F.coalesce(F.exists(f.slice(2, f.size), lambda v: trimmed(v) == "DOCU_SHEET") & (TYPE == "ASSP"), F.lit(False))
    return F.when(
        TYPE.isin(*KINDS["property"]) & (f.size >= 4) & good,
        F.struct(
            status.alias("part_status"), strings.alias("associated_strings"), dta.alias("dimension_text_attribute"), ints.alias("integer_definition"), nums.alias("numeric_definition"), happ.alias("hatch_pattern"),
            F.coalesce(layers, F.array().cast("array<string>")).alias("layers"), sheet.alias("is_sheet"), _values(),
        ),
    )


def tolerance() -> Column:
    a = f.u(9)
    h, v = _alignment(a)
    good = _all(f.size == 10, a.between(1, 9), _ok(f.i(2), f.f(3), f.f(4), f.i(5), f.u(8)))
    return F.when(
        (TYPE == "DTV") & good,
        F.struct(
            f.i(2).alias("definition_value"), f.f(3).alias("upper_value"), f.f(4).alias("lower_value"), f.i(5).alias("format_value"), text_value(6).alias("upper_text"), text_value(7).alias("lower_text"),
            f.u(8).alias("text_style_id"), a.alias("alignment"), h.alias("horizontal"), v.alias("vertical"), _values(),
        ),
    )


def leader_readings() -> dict[str, Column]:
    s = F.col("start")
    k = f.count(s + 2)

    def vertex(j: Column) -> Column:
        at = s + 3 + 3 * j
        return F.struct(f.f(at).alias("x"), f.f(at + 1).alias("y"), f.f(at + 2).alias("elevation"))

    return {"vertices__": F.when(TYPE == "LED", F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), vertex))}


def leader() -> Column:
    """LED, from leader_readings()."""
    s, points = F.col("start"), F.col("vertices__")
    good = _all(F.col("graphic").isNotNull(), f.i(s).isNotNull(), f.f(s + 1) > 0, F.forall(points, lambda p: p.x.isNotNull() & p.y.isNotNull() & p.elevation.isNotNull()))
    return F.when((TYPE == "LED") & good, F.struct(f.i(s).alias("arrow_type"), f.f(s + 1).alias("arrow_size"), points.alias("points"), _values()))


def contour() -> Column:
    s = F.col("start")
    ids = f.us(s + 3, f.count(s + 2))
    good = _all(F.col("graphic").isNotNull(), _ok(f.b(s), f.i(s + 1)), whole(ids))
    return F.when((TYPE == "COC") & good, F.struct(f.b(s).alias("closed"), f.i(s + 1).alias("orientation"), ids.alias("component_ids"), _values()))


def hatch() -> Column:
    s = F.col("start")
    good = _all(F.col("graphic").isNotNull(), _ok(f.f(s), f.f(s + 1), f.f(s + 2)), f.f(s + 3) > 0)
    return F.when((TYPE == "HAT") & good, F.struct(_point(f.f(s), f.f(s + 1)).alias("reference_point"), f.f(s + 2).alias("angle"), f.f(s + 3).alias("spacing"), _values()))


def hatch_assoc() -> Column:
    k = f.count(2)
    inner = f.count(k + 5)
    props, loops = f.us(3, k), f.us(k + 6, inner)
    good = _all(f.size >= 6, f.size == k + 6 + inner, whole(props), whole(loops), _ok(f.u(k + 3), f.u(k + 4)))
    return F.when(
        (TYPE == "PFA") & good,
        F.struct(F.filter(props, lambda x: x != 0).alias("property_ids"), f.u(k + 3).alias("hatch_id"), f.u(k + 4).alias("outer_loop_id"), loops.alias("inner_loop_ids"), _values()),
    )


def symbol() -> Column:
    ids = f.us(2, 3)
    return F.when((TYPE == "SYML") & _all(f.size == 5, whole(ids)), F.struct(ids.alias("component_ids"), _values()))


def dimension() -> Column:
    k = f.count(2)
    at = k + 3
    out = F.when(F.lit(False), F.lit(None))
    for name, (least, geometry, points, position, measure) in DIMENSIONS.items():
        m = at + measure
        props = f.us(3, k)
        g, p = F.array(*[f.u(at + i) for i in geometry]), F.array(*[f.u(at + i) for i in points]).cast("array<bigint>")
        good = _all(f.size >= least, f.size >= m + 2, F.size(props) == k, whole(props), whole(g), whole(p), _ok(f.u(m - 4), f.u(m - 2), f.f(at + position), f.f(at + position + 1), f.f(m)))
        made = F.struct(
            F.filter(props, lambda x: x != 0).alias("property_ids"), g.alias("reference_geometry_ids"), p.alias("reference_point_ids"), _point(f.f(at + position), f.f(at + position + 1)).alias("text_position"),
            f.f(m).alias("measurement"), text_value(m + 1).alias("formatted_text"), F.when(f.u(m - 4) != 0, f.u(m - 4)).alias("dimension_style_id"), F.when(f.u(m - 2) != 0, f.u(m - 2)).alias("text_style_id"), _values(),
        )
        out = out.when((TYPE == name) & good, made)
    return out


_INSTANCE = T.StructType([
    T.StructField("relation_value", T.StringType()), T.StructField("definition_values", T.ArrayType(T.StringType())), T.StructField("member_ids", T.ArrayType(T.LongType())), T.StructField("assembly_id", T.LongType()),
    T.StructField("transform_values", T.ArrayType(T.DoubleType())),
])


def children(fields: list[str], start: int, count: int) -> list[dict] | None:
    """``count`` placements from ``start`` on, read from left to right in one walk; null if they do not fill the record but for its ordinal."""
    at, size, out = start, len(fields), []
    for j in range(count):
        relation = None
        if j:
            if at >= size:
                return None
            relation, at = fields[at], at + 1
        members = number(fields[at + 3]) if at + 3 < size else None
        if members is None or at + members + 14 > size:
            return None
        target = at + 4 + members
        ids, own, matrix = [number(x) for x in fields[at + 4 : target]], number(fields[target]), [real(x) for x in fields[target + 1 : target + 10]]
        if own is None or None in ids or None in matrix:
            return None
        out.append({"relation_value": relation, "definition_values": fields[at : at + 3], "member_ids": ids, "assembly_id": own, "transform_values": matrix})
        at = target + 10
    return out if at + 1 == size and number(fields[at]) is not None else None


def _children_of() -> Callable[..., Column]:
    kind = T.ArrayType(_INSTANCE)

    @F.arrow_udf(kind)
    def read(fields: pa.Array, start: pa.Array, count: pa.Array) -> pa.Array:
        rows = zip(fields.to_pylist(), start.to_pylist(), count.to_pylist(), strict=True)
        return pa.array([None if f is None or a is None or n is None else children(f, a, n) for f, a, n in rows], to_arrow_type(kind))

    return read


def assembly() -> Column:
    """ASSE: a list of children of varying width. Records of other types do not reach the reader."""
    k = f.count(2)
    name_at = k + 3
    n = f.count(name_at + 6)
    none = F.slice(F.array(F.lit(None).cast(_INSTANCE)), 1, 0)
    long = (TYPE == "ASSE") & (n > 0) & (f.size >= name_at + 7 + 15 * n)
    read = F.when(f.size <= name_at + 6, none).when(n == 0, F.when(f.size == name_at + 7, none)).when(long, _children_of()(F.when(long, f.array), F.when(long, name_at + 7), F.when(long, n)))
    props = f.us(3, k)
    return F.when(
        TYPE == "ASSE",
        let(read, lambda r: F.when(_all(f.size >= 5, f.size >= name_at + 1, whole(props), r.isNotNull()), F.struct(props.alias("property_ids"), text_value(name_at).alias("part_name"), r.alias("instances"), _values()))),
    )


DECODERS = {
    "point": point, "line": line, "arc": arc, "bspline": bspline, "circle": circle, "text": text, "property": property_, "tolerance": tolerance, "leader": leader, "contour": contour, "hatch": hatch,
    "hatch_assoc": hatch_assoc, "symbol": symbol, "dimension": dimension, "assembly": assembly,
}


#: What decoders read many times is a column of its own, as an expression is evaluated wherever it stands.
READINGS = {"text": text_readings, "leader": leader_readings}

#: Record types with a decoder, and the variant column of each kind.
KNOWN = frozenset(t for types in KINDS.values() for t in types)
VARIANT = {kind: "arc" if kind == "fillet" else kind for kind in KINDS}
_built: dict[object, dict] = {}


def _session_cache() -> dict:
    """Expressions and types of decoded columns; they depend on names alone, so one set serves a whole session."""
    context = SparkContext._active_spark_context
    if context not in _built:
        _built.clear()
        _built[context] = {"starts": content_starts(), "graphic": graphic_header(), "types": None, "readings": {name: read() for name, read in READINGS.items()}} | {name: build() for name, build in DECODERS.items()}
    return _built[context]


def _variants(records: DataFrame, names: list[str], made: dict, types: set[str] | frozenset[str]) -> DataFrame:
    """Records with readings of the named variants; layouts of other record types than ``types`` are not planned."""
    start0 = F.when(F.lit(False), F.lit(0))
    for group, start in made["starts"].items():
        if have := [t for t in group if t in types]:
            start0 = start0.when(TYPE.isin(*have), start)
    # Content starts after a property list counted at field 5, or at field 6.
    headed = [t for group in made["starts"] for t in group if t in types]
    after = lambda i: F.when(TYPE.isin(*headed), f.count(i) + i + 1) if headed else F.lit(None).cast("int")
    base = records.where(F.col("entity_id").isNotNull()).withColumns({"legacy__": after(5), "modern__": after(6)}).withColumn("start0", start0)
    start = F.when(TYPE == "TEX", (F.col("start0") / 2).cast("int")).otherwise(F.col("start0"))
    readings = {n: x for name in names for n, x in made["readings"].get(name, {}).items()}
    return base.withColumn("start", start).withColumn("graphic", made["graphic"]).withColumns(readings).withColumns({name: made[name] for name in names})


def present_types(records: DataFrame) -> set[str]:
    """Which of the known record types occur; reads one column."""
    return {r[0] for r in records.where(F.col("record_type").isin(*KNOWN)).select("record_type").distinct().collect()}


def decode(records: DataFrame, present: set[str] | None = None, sparse: bool = False) -> DataFrame:
    """Records with a valid id as entities: kind, graphic style, and one nullable struct a variant.

    With ``present``, only the decoders of those record types are planned; other variants are null, or
    with ``sparse`` no columns at all.
    """
    made = _session_cache()
    kinds = [k for k, types in KINDS.items() if present is None or present & set(types)]
    used = [n for n in DECODERS if n in {VARIANT[k] for k in kinds}]
    out = _variants(records, used, made, KNOWN if present is None else present)
    if not sparse:
        if made["types"] is None:
            made["types"] = {x.name: x.dataType for x in _variants(records, list(DECODERS), made, KNOWN).schema}
        out = out.withColumns({n: F.lit(None).cast(made["types"][n]) for n in DECODERS if n not in used})
    kind = F.when(F.lit(False), "")
    for name in kinds:
        kind = kind.when(TYPE.isin(*KINDS[name]) & F.col(VARIANT[name]).isNotNull(), name)
    out = out.withColumn("kind", kind.otherwise("unsupported"))
    return out.select(
        "drawing_id", "entity_index", "entity_id", F.col("record_type").alias("mi_type"), "kind", "record_index", "section_number", "part_index", (F.col("entity_index") == F.col("first_index")).alias("is_first"), "first_index",
        F.col("kind").isin(*GRAPHIC_KINDS).alias("is_graphic"), F.col("kind").isin(*ANNOTATION_KINDS).alias("is_annotation"), F.col("record_type").isin(*KNOWN).alias("known_type"),
        F.struct("offset", F.col("payload_length").alias("length"), "start_line", F.col("payload_end_line").alias("end_line")).alias("payload_span"),
        F.when(F.col("kind") != "unsupported", F.col("graphic")).alias("graphic"), *(used if sparse else DECODERS), "fields", "bad_fields", "type_line",
    )
