"""Parts, assemblies and the tree they form."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.geometry import compose, from_values, identity
from ..functions.strict import trimmed
from .resolve import KEY, index, part_lists

Keep = Callable[[DataFrame, str], DataFrame]
BOUND = "drawing_id string, entity_index long, part_index long, by_name boolean"


def part_names(sections: DataFrame) -> DataFrame:
    """(drawing_id, part_index, definition_section_index, raw_name, name) of each section 6."""
    at = F.array_position(F.transform("fields", lambda x: trimmed(x) != ""), True)
    rows = sections.where("number = 6")
    return rows.select(
        KEY, "part_index", F.col("section_index").alias("definition_section_index"), F.coalesce(F.get("fields", (at - 1).cast("int")), F.lit("")).alias("raw_name"),
        F.when(at > 0, F.get("texts", (at - 1).cast("int"))).otherwise("").alias("name"), F.col("body_span").alias("span"),
    )


def bind(entities: DataFrame, parts: DataFrame) -> DataFrame:
    """Which part each assembly defines: the first free part of its name, else the free part of its own ordinal.

    The match is greedy and depends on order, so each drawing's small lists go through one function.
    """
    a = entities.where("kind = 'assembly'").select(KEY, "entity_index", F.decode("assembly.part_name.raw_bytes", "ISO-8859-1").alias("name"), F.lit(None).cast("long").alias("part_index"))
    p = parts.select(KEY, F.lit(None).cast("long").alias("entity_index"), F.col("raw_name").alias("name"), "part_index")

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["entity_index"].notna()].sort_values("entity_index")
        free: dict[str, deque[int]] = {}
        left = rows[rows["part_index"].notna()].sort_values("part_index")
        for name, at in zip(left["name"], left["part_index"].astype(int), strict=True):
            free.setdefault(name, deque()).append(at)
        taken: set[int] = set()
        total, out = len(left), []
        for ordinal, (at, name) in enumerate(zip(own["entity_index"].astype(int), own["name"], strict=True)):
            same = free.get(name, ())
            while same and same[0] in taken:
                same.popleft()
            found = same[0] if same else None
            chosen = found if found is not None else ordinal if ordinal < total and ordinal not in taken else None
            if chosen is not None:
                taken.add(chosen)
            out.append((rows[KEY].iloc[0], at, chosen, found is not None))
        made = pd.DataFrame(out, columns=[KEY, "entity_index", "part_index", "by_name"])
        return made.astype({"part_index": "Int64", "entity_index": "int64", "by_name": "bool"})

    return a.unionByName(p).groupBy(KEY).applyInPandas(match, BOUND)


def instances(entities: DataFrame, bound: DataFrame) -> DataFrame:
    """Placements: one row for each child of each assembly, with both parts and the sheet flag."""
    a = entities.where("kind = 'assembly'").select(KEY, "entity_index", F.col("entity_id").alias("owner_id"), "payload_span", F.posexplode("assembly.instances").alias("instance_index", "i"))
    rows = a.join(bound.select(KEY, "entity_index", F.col("part_index").alias("parent_part_index")), [KEY, "entity_index"], "left")
    ids = entities.where("kind = 'assembly'").select(KEY, "entity_index", "entity_id").join(bound.where("part_index is not null").select(KEY, "entity_index", "part_index"), [KEY, "entity_index"])
    first = ids.groupBy(F.col(KEY).alias("k__"), F.col("entity_id").alias("t__")).agg(F.min_by("part_index", "entity_index").alias("target_part_index"))
    rows = rows.select(KEY, "entity_index", "owner_id", "payload_span", F.col("instance_index").cast("long").alias("instance_index"), "parent_part_index", "i.*")
    rows = rows.join(first, (rows[KEY] == first["k__"]) & (rows["assembly_id"] == first["t__"]), "left").drop("k__", "t__")
    sheets = entities.where("kind = 'property' and property.is_sheet").select(KEY, F.col("entity_id").alias("member")).distinct()
    marked = rows.select(KEY, "entity_index", "instance_index", F.explode("member_ids").alias("member")).join(sheets, [KEY, "member"], "left_semi").select(KEY, "entity_index", "instance_index").distinct()
    return rows.join(marked.withColumn("is_sheet", F.lit(True)), [KEY, "entity_index", "instance_index"], "left").withColumn("is_sheet", F.coalesce("is_sheet", F.lit(False))).withColumn("transform", from_values(F.col("transform_values")))


def parts(names: DataFrame, entities: DataFrame, bound: DataFrame, placed: DataFrame) -> DataFrame:
    """Part definitions with their assembly, the ids they own, and their children and parents in source order."""
    own = bound.where("part_index is not null").join(entities.where("kind = 'assembly'").select(KEY, "entity_index", F.col("entity_id").alias("assembly_id")), [KEY, "entity_index"]).select(KEY, "part_index", "assembly_id")
    edges = placed.where("parent_part_index is not null and target_part_index is not null")
    ordered = lambda value: F.transform(F.array_sort(F.collect_list(F.struct("entity_index", "instance_index", F.col(value).alias("v")))), lambda x: x["v"])
    down = edges.groupBy(KEY, F.col("parent_part_index").alias("part_index")).agg(ordered("target_part_index").alias("child_part_indices"))
    up = edges.groupBy(KEY, F.col("target_part_index").alias("part_index")).agg(F.array_distinct(ordered("parent_part_index")).alias("parent_part_indices"))
    out = names
    for side in (own, part_lists(entities), down, up):
        out = out.join(side, [KEY, "part_index"], "left")
    lists = [c for c in out.columns if c.endswith("_ids") or c.endswith("_indices")]
    return out.withColumns({c: F.coalesce(c, F.array().cast("array<bigint>")) for c in lists})


def roots(part_rows: DataFrame) -> DataFrame:
    """(drawing_id, root_part_indices, top_part_index): the only root, else the part named top, else the first root, else part 0."""
    root = F.size("parent_part_indices") == 0
    found = part_rows.groupBy(KEY).agg(
        F.array_sort(F.collect_list(F.when(root, F.col("part_index")))).alias("root_part_indices"), F.min(F.when(F.lower("raw_name") == "top", F.col("part_index"))).alias("named")
    )
    top = F.when(F.size("root_part_indices") == 1, F.get("root_part_indices", F.lit(0))).otherwise(F.coalesce("named", F.get("root_part_indices", F.lit(0)), F.lit(0)))
    return found.select(KEY, "root_part_indices", top.alias("top_part_index"))


#: Columns of an occurrence; segments of paths have the same, from their first part on.
_STEP = ("path", "parts", "local", "world", "parent_part_index", "is_sheet")


def _joined(before: DataFrame, after: DataFrame, own: list[str]) -> DataFrame:
    """Paths before, each with every segment after it that begins where it ends and has none of its parts."""
    a, b = F.col("a"), F.col("b")
    left = before.select(F.col(KEY).alias("k__"), F.col("part_index").alias("p__"), F.struct(*own, "part_index", *_STEP).alias("a"))
    right = after.select(F.col(KEY).alias("l__"), F.col("tail").alias("t__"), F.struct("part_index", *_STEP).alias("b"))
    rows = left.join(right, (F.col("k__") == F.col("l__")) & (F.col("p__") == F.col("t__"))).where(~F.arrays_overlap(a["parts"], b["parts"]))
    return rows.select(
        F.col("k__").alias(KEY), *[a[n].alias(n) for n in own], b["part_index"].alias("part_index"), F.concat(a["path"], b["path"]).alias("path"), F.concat(a["parts"], b["parts"]).alias("parts"), b["local"].alias("local"),
        compose(a["world"], b["world"]).alias("world"), b["parent_part_index"].alias("parent_part_index"), b["is_sheet"].alias("is_sheet"),
    )


def _counted(df: DataFrame, name: str, keep: Keep) -> tuple[DataFrame, bool]:
    """The table as written, and whether it has rows."""
    seen = Observation()
    out = keep(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"] > 0


def refused(rows: DataFrame, message: Column, like: DataFrame) -> DataFrame:
    """No rows of like's columns; each row of ``rows`` raises its message once the plan runs."""
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema]
    # A condition that is not deterministic as a whole stays above the joins that pick the rows.
    told = F.concat("m__", F.substring(F.rand().cast("string"), 1, 0))
    return rows.select(message.alias("m__")).where(F.raise_error(told).cast("boolean")).select(*none)


def occurrences(placed: DataFrame, start: DataFrame, keep: Keep, strict: bool = True) -> DataFrame:
    """Placed parts below ``start`` (drawing_id, part_index), the start included, at any depth.

    Path doubling: segments of 1, 2, 4, ... placements are written out, each joined from two halves, and what
    is known up to a depth is joined once with the segments of that length. A tree of depth n takes about
    2 log2(n) joins, and no more segments of a length than the tree has occurrences below parts that it
    reaches. path lists (assembly_id, instance_index); sorting by drawing and ``order_key`` gives pre-order.
    World maps are parent after local. Unbound, cyclic and non-affine placements below the start raise when
    the plan runs, or are left out if not strict. keep: writes a table and reads it back.
    """
    id_ = F.struct(F.col("owner_id").alias("assembly_id"), "instance_index")
    edges = placed.where("parent_part_index is not null").select(
        KEY, F.col("parent_part_index").alias("tail"), F.col("target_part_index").alias("part_index"), F.array(id_).alias("path"), F.array("target_part_index").alias("parts"), F.col("transform").alias("local"),
        F.col("transform").alias("world"), "parent_part_index", "is_sheet",
    )
    segments, more = _counted(edges.where("part_index is not null and local is not null and part_index <> tail"), "segments", keep)
    part = F.col("part_index").cast("long")
    roots = start.select(KEY, part.alias("part_index")).select(
        KEY, "part_index", F.slice(F.array(F.lit(None).cast(segments.schema["path"].dataType.elementType)), 1, 0).alias("path"), F.array("part_index").alias("parts"), identity().alias("local"), identity().alias("world"),
        F.lit(None).cast("long").alias("parent_part_index"), F.lit(False).alias("is_sheet"),
    )
    known = roots
    while more:
        found, more = _counted(_joined(known, segments, []), "occurrences", keep)
        known = known.unionByName(found)
        if more:
            segments, more = _counted(_joined(segments, segments, ["tail"]), "segments", keep)
    out = known.select(KEY, "part_index", F.size("path").alias("depth"), "path", F.transform("path", lambda p: p["instance_index"]).alias("order_key"), "local", "world", "parent_part_index", "is_sheet")
    if not strict:
        return out
    wrong = {"the placement has no bound part": edges["part_index"].isNull(), "the assembly contains itself": F.array_contains("o__", edges["part_index"]), "the placement is not affine": edges["local"].isNull()}
    message = F.when(F.lit(False), "")
    for why, hit in wrong.items():
        message = message.when(hit, F.lit(why))
    reached = known.select(F.col(KEY).alias("k__"), F.col("part_index").alias("p__"), F.col("parts").alias("o__"))
    bad = edges.join(reached, (edges[KEY] == F.col("k__")) & (edges["tail"] == F.col("p__"))).select(message.alias("why")).where("why is not null")
    return out.unionByName(refused(bad, F.col("why"), out))


def unresolved_instances(placed: DataFrame, entities: DataFrame) -> DataFrame:
    """Placements whose target is no bound assembly, with whether the id exists."""
    known = index(entities).select(F.col(KEY).alias("k__"), F.col("id").alias("i__"), F.lit(True).alias("exists"))
    lost = placed.where("target_part_index is null")
    return lost.join(known, (lost[KEY] == known["k__"]) & (lost["assembly_id"] == known["i__"]), "left").drop("k__", "i__").withColumn("exists", F.coalesce("exists", F.lit(False)))
