"""Corpus statistics as one long frame (metric, item, value, count)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import color_name
from .resolve import KEY


#: Roles of pointers whose targets may be missing, by the metric that counts them.
UNRESOLVED = {"unresolved_geometry": "dimension geometry", "unresolved_points": "dimension reference", "contour_unresolved_components": "contour component", "symbol_unresolved_components": "symbol component"}


def unresolved(entities: DataFrame, references: DataFrame) -> DataFrame:
    """(mi_type, kind, and a count for each of UNRESOLVED) of dimensions, contours and symbols, from the table of pointers; owners without any count zero."""
    bad = references.where((F.col("status") != "ok") & F.col("role").isin(*UNRESOLVED.values()))
    counts = bad.groupBy(KEY, "entity_index").agg(*[F.count(F.when(F.col("role") == role, 1)).alias(name) for name, role in UNRESOLVED.items()])
    owners = entities.where("kind in ('dimension', 'contour', 'symbol')").select(KEY, "entity_index", "kind", "mi_type")
    return owners.join(counts, [KEY, "entity_index"], "left").withColumns({name: F.coalesce(name, F.lit(0)) for name in UNRESOLVED})


def counted(frames: list[DataFrame], by: tuple[str, ...], keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(by, count) over all frames. Each is counted by a job of its own: tasks of one plan for all carry the metrics of all, which the driver holds until the last has ended. keep: writes a table and reads it back."""
    parts = [keep(rows.groupBy(*by).count(), "counts") for rows in frames]
    total = parts[0]
    for more in parts[1:]:
        total = total.unionByName(more)
    return total.groupBy(*by).agg(F.sum("count").alias("count"))


def by_file(source: DataFrame, drawings: DataFrame, records: DataFrame, entities: DataFrame, diagnostics: list[DataFrame], keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """A row a drawing that could be read: sha256 of its bytes as stored, sizes, version, encoding, and counts of record types, entities and diagnostic codes."""

    def tally(frames: list[DataFrame], column: str, name: str) -> DataFrame:
        each = counted([rows.where(F.col(column).isNotNull()) for rows in frames], (KEY, column), keep)
        return each.groupBy(KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "count")))).alias(name))

    typed = F.col("kind") != "unsupported"
    sides = [
        source.select(KEY, F.sha2("content", 256).alias("sha256")), tally([records], "record_type", "raw_record_counts"),
        keep(entities.groupBy(KEY).agg(F.count(F.when(typed, 1)).alias("typed_entities"), F.count(F.when(~typed, 1)).alias("unsupported_entities")), "counts"), tally(diagnostics, "code", "diagnostic_codes"),
    ]
    out = drawings.where("error is null").select(KEY, "container_size", F.col("source_size").alias("logical_size"), "version", F.col("encoding.name").alias("encoding"), F.col("format.compression").alias("compression"))
    for side in sides:
        out = out.join(side, KEY, "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return out.withColumns({**{c: F.coalesce(c, none) for c in ("raw_record_counts", "diagnostic_codes")}, **{c: F.coalesce(c, F.lit(0)) for c in ("typed_entities", "unsupported_entities")}})


def audit(records: DataFrame, entities: DataFrame, hatch_rows: DataFrame | None, dimension_rows: DataFrame | None, diagnostics: list[DataFrame], references: DataFrame | None, layers: DataFrame, patterns: DataFrame | None, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Counts of records, kinds, styles, layers, splines, annotations, unresolved targets, properties, placements and diagnostics.

    Each entity is turned into its (metric, item, value) triples in place, so one aggregation counts them all. Rows are none
    where no record can have any: hatches and patterns, dimensions, and references of dimensions, contours and symbols.
    """
    string = lambda v: F.coalesce(v.cast("string"), F.lit("null"))

    def triple(metric: str, item: Column, value) -> Column:
        return F.struct(F.lit(metric).alias("metric"), item.alias("item"), (string(value) if isinstance(value, Column) else F.lit(value)).alias("value"))

    def when(cond: Column, *triples: Column) -> Column:
        return F.when(cond, F.array(*triples)).otherwise(F.array().cast("array<struct<metric:string,item:string,value:string>>"))

    kind, mi = F.col("kind"), F.col("mi_type")
    g = lambda name: F.col(f"graphic.{name}")
    style = F.lit("graphics")
    found = F.concat(
        when(kind == "unsupported", triple("unsupported", mi, "")),
        when(kind != "unsupported", triple("typed", mi, "")),
        when(kind == "property", triple("property_model", mi, "")),
        when(
            F.col("graphic").isNotNull(), triple("colors", style, g("color")), triple("color_names", style, color_name(g("color"))), triple("linetypes", style, g("linetype")), triple("lineweights", style, g("lineweight")),
            triple("visibility", style, g("visibility")), triple("visibility_values", style, g("visibility_value")), triple("property_counts", style, F.size(g("property_ids"))),
        ),
        when(kind.isin("arc", "fillet"), triple("orientation", mi, F.col("arc.orientation")), triple("ccw", mi, F.col("arc.ccw"))),
        when(
            kind == "bspline", triple("orders", mi, F.col("bspline.order")), triple("control_point_counts", mi, F.size("bspline.control_point_ids")), triple("prefix_lengths", mi, F.size("bspline.prefix_values")),
            triple("definition_values", mi, F.array_join("bspline.definition_values", ",")), triple("weight_presence", mi, F.col("bspline.weights").isNotNull()),
            *[triple(name, mi, F.col(f"bspline.{name}")) for name in ("closed", "periodic", "rational")],
        ),
        when(kind == "dimension", triple("geometry_reference_counts", mi, F.size("dimension.reference_geometry_ids")), triple("point_reference_counts", mi, F.size("dimension.reference_point_ids"))),
        when(kind == "leader", triple("leader_vertex_counts", mi, F.size("leader.points"))),
        when(kind == "contour", triple("contour_component_counts", mi, F.size("contour.component_ids"))),
        when(kind == "symbol", triple("symbol_component_counts", mi, F.size("symbol.component_ids"))),
        when(kind == "tolerance", triple("tolerance_text", mi, F.col("tolerance.upper_text.text").isNotNull() & F.col("tolerance.lower_text.text").isNotNull())),
        F.coalesce(F.transform("assembly.instances", lambda i: triple("transform_values", mi, F.array_join(i["transform_values"].cast("array<string>"), ","))), F.array().cast("array<struct<metric:string,item:string,value:string>>")),
    )
    raw = when(
        F.col("record_type").isNotNull(), triple("raw", F.col("record_type"), ""), triple("field_counts", F.col("record_type"), F.size("fields")),
        triple("terminal_field_values", F.col("record_type"), F.when(F.col("record_type").isin("ARC", "FIL"), F.element_at("fields", -1))),
    )
    drawn = entities.where("graphic is not null").select(KEY, "entity_index").join(layers, [KEY, "entity_index"], "left")
    rows = [
        drawn.select(triple("layer_counts", style, F.coalesce(F.size("layers"), F.lit(0))).alias("t")),
        entities.select(F.explode(found).alias("t")),
        records.select(F.explode(raw).alias("t")).where("t.metric <> 'terminal_field_values' or t.item in ('ARC', 'FIL')"),
        *[some.select(triple("diagnostic_codes", F.col("code"), "").alias("t")) for some in diagnostics],
    ]
    if references is not None:
        kinds = {"dimension": ("unresolved_geometry", "unresolved_points"), "contour": ("contour_unresolved_components",), "symbol": ("symbol_unresolved_components",)}
        told = F.concat(*[when(kind == k, *[triple(name, mi, F.col(name)) for name in names]) for k, names in kinds.items()])
        rows.append(unresolved(entities, references).select(F.explode(told).alias("t")))
    if hatch_rows is not None:
        patterned = hatch_rows.select(KEY, "entity_index", "mi_type").join(patterns.select(KEY, "entity_index", F.lit(True).alias("have")), [KEY, "entity_index"], "left")
        rows.append(patterned.select(triple("hatch_pattern_present", F.col("mi_type"), F.coalesce("have", F.lit(False))).alias("t")))
        rows.append(hatch_rows.select(triple("hatch_boundary_counts", F.col("mi_type"), F.size("boundary_loop_ids")).alias("t")))
    if dimension_rows is not None:
        rows.append(dimension_rows.select(F.explode(F.array(triple("tolerance_counts", F.col("mi_type"), F.size("tolerance_ids")), triple("decoded_text", F.col("mi_type"), F.col("formatted_text.text").isNotNull()))).alias("t")))
    return counted([some.select("t.*") for some in rows], ("metric", "item", "value"), keep)
