"""References between entities, as equi-joins on (drawing_id, id).

The first entity with an id is what pointers to that id mean. A pointer that finds nothing, or the
wrong class, keeps its row with null coordinates and shows up in ``references``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import angle, distance
from ..functions.strict import unsigned
from .decode import GRAPHIC_KINDS

KEY = "drawing_id"
#: Beyond the number of pointers or fields that a record can have.
LATE = 1 << 40
#: Kinds that satisfy each class of pointer.
CLASSES = {"point": ("point",), "property": ("property",), "graphic": GRAPHIC_KINDS, "contour": ("contour",), "hatch": ("hatch",)}


def index(entities: DataFrame) -> DataFrame:
    """(drawing_id, id, kind) of what each id means."""
    return entities.where("is_first").select(KEY, F.col("entity_id").alias("id"), "kind")


def points(entities: DataFrame) -> DataFrame:
    return entities.where("is_first and kind = 'point'").select(KEY, F.col("entity_id").alias("id"), F.col("point").alias("at"))


def with_points(df: DataFrame, located: DataFrame, **pointers: str) -> DataFrame:
    """df (unique by drawing_id and entity_index) with a point column for each ``name=id column``; null where the id has no point.

    All pointers of a row go through one join: only they are dealt out by id, and come back as one narrow row.
    """
    roles = F.array(*[F.struct(F.lit(i).alias("role"), F.col(column).alias("id")) for i, column in enumerate(pointers.values())])
    flat = df.select(KEY, "entity_index", F.explode(roles).alias("p")).select(KEY, "entity_index", "p.role", "p.id")
    side = located.select(F.col(KEY).alias("k__"), F.col("id").alias("i__"), F.col("at.x").alias("x"), F.col("at.y").alias("y"))
    found = flat.join(side, (F.col(KEY) == F.col("k__")) & (F.col("id") == F.col("i__")))
    packed = found.groupBy(KEY, "entity_index").agg(*[F.max(F.when(F.col("role") == i, F.col(c))).alias(f"{c}{i}__") for i in range(len(pointers)) for c in "xy"])
    out = df.join(packed, [KEY, "entity_index"], "left")
    made = {name: F.when(F.col(f"x{i}__").isNotNull(), F.struct(F.col(f"x{i}__").alias("x"), F.col(f"y{i}__").alias("y"))) for i, name in enumerate(pointers)}
    return out.withColumns(made).drop(*[f"{c}{i}__" for i in range(len(pointers)) for c in "xy"])


def point_arrays(df: DataFrame, located: DataFrame, key: str, **pointers: str) -> DataFrame:
    """df (unique by drawing_id and ``key``) with an array of points, in order and null where missing, for each array of ids."""
    for name, column in pointers.items():
        flat = df.select(KEY, key, F.posexplode(column).alias("pos", "id"))
        side = located.select(F.col(KEY).alias("k__"), F.col("id").alias("i__"), "at")
        found = flat.join(side, (flat[KEY] == side["k__"]) & (flat["id"] == side["i__"]), "left")
        packed = found.groupBy(KEY, key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "at"))), lambda v: v["at"]).alias(name))
        df = df.join(packed, [KEY, key], "left")
    return df


def _common(entities: DataFrame, kind: str | tuple[str, ...], *more) -> DataFrame:
    kinds = (kind,) if isinstance(kind, str) else kind
    return entities.where(F.col("kind").isin(*kinds)).select(KEY, "entity_index", "entity_id", "mi_type", "part_index", *more)


def lines_geo(entities: DataFrame, located: DataFrame) -> DataFrame:
    rows = _common(entities, "line", "graphic", "line.start_id", "line.end_id")
    return with_points(rows, located, start="start_id", end="end_id")


def arcs(entities: DataFrame, located: DataFrame) -> DataFrame:
    rows = with_points(_common(entities, ("arc", "fillet"), "graphic", "arc.*"), located, center="center_id", start="start_id", end="end_id")
    c, s, e = F.col("center"), F.col("start"), F.col("end")
    return rows.withColumns({"radius": distance(c, s), "start_angle": angle(c, s), "end_angle": angle(c, e)})


def circles(entities: DataFrame, located: DataFrame) -> DataFrame:
    rows = with_points(_common(entities, "circle", "graphic", "circle.*"), located, center="center_id", circumference="circumference_id")
    return rows.withColumn("radius", distance(F.col("center"), F.col("circumference")))


def bsplines(entities: DataFrame, located: DataFrame) -> DataFrame:
    rows = with_points(_common(entities, "bspline", "graphic", "bspline.*"), located, start="start_id", end="end_id")
    rows = rows.withColumn("sample_ids", F.transform("samples", lambda s: s["point_id"]))
    rows = point_arrays(rows, located, "entity_index", control_points="control_point_ids", sample_points="sample_ids")
    domain = F.struct(F.get("knots", F.col("degree")).alias("start"), F.get("knots", F.size("control_point_ids")).alias("end"))
    return rows.withColumn("domain", domain).drop("sample_ids")


def hatches(entities: DataFrame) -> DataFrame:
    """Hatches with the loops of their last association, the outer one first."""
    loops = hatch_loops(entities)
    rows = _common(entities, "hatch", "graphic", "hatch.*")
    return rows.join(loops, (rows[KEY] == loops["k__"]) & (rows["entity_id"] == loops["hatch__"]), "left").drop("k__", "hatch__").withColumn("boundary_loop_ids", F.coalesce("boundary_loop_ids", F.array().cast("array<bigint>")))


def hatch_loops(entities: DataFrame) -> DataFrame:
    a = entities.where("kind = 'hatch_assoc'").select(KEY, "entity_index", "hatch_assoc.*")
    both = F.concat(F.array("outer_loop_id"), F.col("inner_loop_ids"))
    return a.groupBy(F.col(KEY).alias("k__"), F.col("hatch_id").alias("hatch__")).agg(F.max_by(both, "entity_index").alias("boundary_loop_ids"))


def dimensions(entities: DataFrame) -> DataFrame:
    """Dimensions with the tolerances that any of their fields names, in order and once."""
    rows = _common(entities, "dimension", "dimension.*")
    known = entities.where("is_first and kind = 'tolerance'").select(F.col(KEY).alias("k__"), F.col("entity_id").alias("t__"))
    flat = rows.select(KEY, "entity_index", F.posexplode("field_values").alias("pos", "value")).select(KEY, "entity_index", "pos", unsigned(F.col("value")).alias("value"))
    found = flat.join(known, (flat[KEY] == known["k__"]) & (flat["value"] == known["t__"]))
    packed = found.groupBy(KEY, "entity_index").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda v: v["value"])).alias("tolerance_ids"))
    return rows.join(packed, [KEY, "entity_index"], "left").withColumn("tolerance_ids", F.coalesce("tolerance_ids", F.array().cast("array<bigint>")))


def layers(entities: DataFrame) -> DataFrame:
    """(drawing_id, entity_index, layers, layer): names from the properties of each graphic, in order and once; layer is the only one or null."""
    flat = entities.where("graphic is not null").select(KEY, "entity_index", F.posexplode("graphic.property_ids").alias("pos", "id"))
    named = entities.where("is_first and kind = 'property'").select(F.col(KEY).alias("k__"), F.col("entity_id").alias("p__"), "property.layers")
    found = flat.join(named, (flat[KEY] == named["k__"]) & (flat["id"] == named["p__"]))
    packed = found.groupBy(KEY, "entity_index").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "layers"))), lambda v: v["layers"]))).alias("layers"))
    return packed.withColumn("layer", F.when(F.size("layers") == 1, F.get("layers", F.lit(0))))


def hatch_patterns(entities: DataFrame) -> DataFrame:
    """(drawing_id, entity_index, entity_id, mi_type, pattern): lines of the first hatch pattern among the properties of each hatch and association that names one."""
    owners = entities.where("kind in ('hatch', 'hatch_assoc')").select(KEY, "entity_index", "entity_id", "mi_type", F.posexplode(F.coalesce("hatch_assoc.property_ids", "graphic.property_ids")).alias("pos", "id"))
    known = entities.where("is_first and kind = 'property' and mi_type = 'HAPP'").select(F.col(KEY).alias("k__"), F.col("entity_id").alias("p__"), F.coalesce("property.hatch_pattern", F.slice(F.col("property.hatch_pattern"), 1, 0)).alias("lines"))
    found = owners.join(known, (owners[KEY] == known["k__"]) & (owners["id"] == known["p__"]))
    return found.groupBy(KEY, "entity_index").agg(F.first("entity_id").alias("entity_id"), F.first("mi_type").alias("mi_type"), F.min_by("lines", "pos").alias("pattern"))


def attached(rows: DataFrame, column: str, targets: DataFrame, name: str, keep_missing: bool = True) -> DataFrame:
    """rows (unique by entity_index) with an array ``name`` of the targets' structs for an array of ids, in order; a missing one is null, or left out.

    targets: drawing_id, entity_id and ``value``, each id once.
    """
    flat = rows.select(KEY, "entity_index", F.posexplode(column).alias("pos", "id"))
    side = targets.select(F.col(KEY).alias("k__"), F.col("entity_id").alias("t__"), F.col("value"))
    found = flat.join(side, (flat[KEY] == side["k__"]) & (flat["id"] == side["t__"]), "left" if keep_missing else "inner")
    packed = found.groupBy(KEY, "entity_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda v: v["value"]).alias(name))
    return rows.join(packed, [KEY, "entity_index"], "left")


def _pointer(role: str, kind: str, target: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.lit(kind).alias("expected"), target.cast("bigint").alias("target"))


def pointers(entities: DataFrame) -> DataFrame:
    """(drawing_id, entity_index, entity_id, payload_span, pos, role, expected, target): every pointer of every record, in order."""
    one = lambda role, kind, column: F.array(_pointer(role, kind, F.col(column)))
    many = lambda role, kind, column: F.transform(column, lambda v: _pointer(role, kind, v))
    style = many("property", "property", "graphic.property_ids")
    groups = [
        F.when(F.col("kind") == "line", F.concat(one("start", "point", "line.start_id"), one("end", "point", "line.end_id"))),
        F.when(F.col("kind").isin("arc", "fillet"), F.concat(one("center", "point", "arc.center_id"), one("start", "point", "arc.start_id"), one("end", "point", "arc.end_id"))),
        F.when(
            F.col("kind") == "bspline",
            F.concat(one("start", "point", "bspline.start_id"), one("end", "point", "bspline.end_id"), many("control", "point", "bspline.control_point_ids"), F.transform("bspline.samples", lambda s: _pointer("sample", "point", s["point_id"]))),
        ),
        F.when(F.col("kind") == "circle", F.concat(one("center", "point", "circle.center_id"), one("circumference", "point", "circle.circumference_id"))),
        F.when(
            F.col("kind") == "dimension",
            F.concat(
                many("property", "property", "dimension.property_ids"), many("dimension reference", "point", "dimension.reference_point_ids"), many("dimension geometry", "graphic", "dimension.reference_geometry_ids"),
                F.filter(F.array(_pointer("style", "property", F.col("dimension.dimension_style_id")), _pointer("text style", "property", F.col("dimension.text_style_id"))), lambda p: p["target"].isNotNull()),
            ),
        ),
        F.when(F.col("kind") == "tolerance", one("text style", "property", "tolerance.text_style_id")),
        F.when(F.col("kind") == "contour", many("contour component", "graphic", "contour.component_ids")),
        F.when(
            F.col("kind") == "hatch_assoc",
            F.concat(many("property", "property", "hatch_assoc.property_ids"), one("associated hatch", "hatch", "hatch_assoc.hatch_id"), one("outer loop", "contour", "hatch_assoc.outer_loop_id"), many("inner loop", "contour", "hatch_assoc.inner_loop_ids")),
        ),
        F.when(F.col("kind") == "symbol", many("symbol component", "graphic", "symbol.component_ids")),
        F.when(F.col("kind") == "assembly", many("property", "property", "assembly.property_ids")),
    ]
    empty = F.array().cast("array<struct<role:string,expected:string,target:bigint>>")
    every = F.concat(*[F.coalesce(g, empty) for g in groups], F.coalesce(F.when(F.col("graphic").isNotNull(), style), empty))
    base = entities.where("kind <> 'unsupported'")
    flat = base.select(KEY, "entity_index", "entity_id", "payload_span", F.posexplode(every).alias("pos", "p")).select(KEY, "entity_index", "entity_id", "payload_span", "pos", "p.*")
    return flat


def _fits() -> Column:
    """Whether what was found is of the class that the pointer expects."""
    fits = F.lit(False)
    for name, kinds in CLASSES.items():
        fits = fits | ((F.col("expected") == name) & F.col("found").isin(*kinds))
    return fits


def references(entities: DataFrame, hatched: bool = True) -> DataFrame:
    """Every pointer with its class and status: ok, dangling or mismatch; hatched: whether there can be hatches."""
    flat = pointers(entities)
    if hatched:
        flat = flat.unionByName(_loop_pointers(entities))
    known = index(entities).select(F.col(KEY).alias("k__"), F.col("id").alias("i__"), F.col("kind").alias("found"))
    joined = flat.join(known, (flat[KEY] == known["k__"]) & (flat["target"] == known["i__"]), "left").drop("k__", "i__")
    return joined.withColumn("status", F.when(F.col("found").isNull(), "dangling").when(_fits(), "ok").otherwise("mismatch"))


def _loop_pointers(entities: DataFrame) -> DataFrame:
    """Pointers of hatches to the loops of their last association, after all their own."""
    owners = entities.where("kind = 'hatch'").select(KEY, "entity_index", "entity_id", "payload_span")
    loops = hatch_loops(entities)
    more = owners.join(loops, (owners[KEY] == loops["k__"]) & (owners["entity_id"] == loops["hatch__"])).select(KEY, "entity_index", "entity_id", "payload_span", F.posexplode("boundary_loop_ids").alias("pos", "target"))
    return more.select(KEY, "entity_index", "entity_id", "payload_span", (F.col("pos") + LATE).alias("pos"), F.lit("hatch boundary loop").alias("role"), F.lit("contour").alias("expected"), "target")


def attachments(entities: DataFrame) -> DataFrame:
    """What each entity's pointers mean, side by side: one table of pointers, one join, one aggregation.

    (drawing_id, entity_index, entity_id, kind, mi_type), then ``properties`` (those that resolve, in order),
    ``geometries`` of dimensions, ``components`` of contours and symbols and ``points`` (each as long as its
    list of ids, null for what is missing or of another class), ``dimension_style`` and ``text_style``.
    Entities without pointers have empty lists.
    """
    target = F.struct("entity_id", "entity_index", "mi_type", F.col("kind").alias("kind"))
    known = entities.where("is_first").select(
        F.col(KEY).alias("k__"), F.col("entity_id").alias("i__"), F.col("kind").alias("found"), target.alias("entity"), F.when(F.col("kind") == "point", F.col("point")).alias("at"),
        F.when(F.col("kind") == "property", F.struct("entity_id", "mi_type", "property.*")).alias("property"),
    )
    flat = pointers(entities).select(KEY, "entity_index", "pos", "role", "expected", "target")
    found = flat.join(known, (flat[KEY] == known["k__"]) & (flat["target"] == known["i__"]), "left")
    found = found.select(KEY, "entity_index", "pos", "role", *[F.when(_fits(), F.col(c)).alias(c) for c in ("entity", "at", "property")])

    def listed(value: str, *roles: str) -> Column:
        rows = F.collect_list(F.when(F.col("role").isin(*roles), F.struct("pos", F.col(value).alias("v"))))
        return F.transform(F.array_sort(rows), lambda x: x["v"])

    packed = found.groupBy(KEY, "entity_index").agg(
        F.filter(listed("property", "property"), lambda v: v.isNotNull()).alias("properties"), listed("entity", "dimension geometry").alias("geometries"), listed("entity", "contour component", "symbol component").alias("components"),
        listed("at", "start", "end", "center", "circumference", "control", "sample", "dimension reference").alias("points"),
        F.get(listed("property", "style"), F.lit(0)).alias("dimension_style"), F.get(listed("property", "text style"), F.lit(0)).alias("text_style"),
    )
    owners = entities.where("kind <> 'unsupported'").select(KEY, "entity_index", "entity_id", "kind", "mi_type")
    out = owners.join(packed, [KEY, "entity_index"], "left")
    return out.withColumns({n: F.coalesce(n, F.array().cast(packed.schema[n].dataType)) for n in ("properties", "geometries", "components", "points")})


def part_lists(entities: DataFrame) -> DataFrame:
    """Ids of each part's entities in source order, by class."""
    owned = entities.where("part_index is not null")
    listed = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("entity_index", "entity_id")))), lambda v: v["entity_id"])
    return owned.groupBy(KEY, "part_index").agg(
        listed(F.col("kind") == "point").alias("point_ids"), listed(F.col("is_graphic")).alias("graphic_ids"), listed(F.col("is_annotation")).alias("annotation_ids"),
        listed(F.col("kind") == "unsupported").alias("unsupported_ids"), listed(F.lit(True)).alias("source_ids"),
    )


def last_ids(entities: DataFrame) -> DataFrame:
    return entities.groupBy(KEY).agg(F.max("entity_id").alias("max_entity_id"))


def numbered(df: DataFrame, *order: str) -> Column:
    """A dense number from 0 within each drawing."""
    return F.row_number().over(Window.partitionBy(KEY).orderBy(*order)) - 1
