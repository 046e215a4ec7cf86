"""Traversal of deep, shared, cyclic and broken trees."""

import pytest
from drawing import asse, child, drawing, section
from pyspark.sql import functions as F

import sparkdraw
from sparkdraw.operators import structure
from sparkdraw.storage import Shelf

PLACED = "drawing_id string, parent_part_index long, target_part_index long, owner_id long, instance_index long, is_sheet boolean, dx double"


def placed(rows):
    unit = F.when(F.col("dx").isNotNull(), F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit(1.0).alias("d"), F.col("dx").alias("tx"), F.lit(0.0).alias("ty")))
    return rows.withColumn("transform", unit)


def walk(spark, edges, strict=True, root=0):
    df = placed(spark.createDataFrame([("d", a, b, a, i, False, dx) for a, b, i, dx in edges], PLACED))
    start = spark.createDataFrame([("d", root)], "drawing_id string, part_index long")
    shelf = Shelf()
    try:
        return sorted((tuple(r.order_key), r.part_index, r.world.tx) for r in structure.occurrences(df, start, shelf.put, strict).collect())
    finally:
        shelf.clear()


def by_recursion(edges, root=0):
    out = []

    def visit(part, key, x, seen):
        out.append((key, part, x))
        for a, b, i, dx in edges:
            if a == part and b is not None and dx is not None and b not in seen:
                visit(b, (*key, i), x + dx, seen | {b})

    visit(root, (), 0.0, {root})
    return sorted(out)


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 7, 8])
def test_every_depth(spark, depth):
    edges = [(k, k + 1, i, float(i + 1)) for k in range(depth) for i in range(2)] + [(0, depth, 2, 100.0), (900, 0, 0, 1.0)]
    assert walk(spark, edges) == by_recursion(edges)


def test_cycles_and_broken_placements(spark):
    """They are left out with what is below them if not strict; below the start they raise, elsewhere they don't matter."""
    fine = [(0, 1, 0, 1.0), (0, 2, 1, 2.0), (2, 1, 0, 4.0), (1, 3, 0, 8.0)]
    for odd, why in (((3, 0, 0, 1.0), "contains itself"), ((3, 3, 0, 1.0), "contains itself"), ((1, None, 1, 1.0), "no bound part"), ((1, 4, 1, None), "not affine")):
        edges = [*fine, odd]
        assert walk(spark, edges, strict=False) == by_recursion(edges)
        with pytest.raises(Exception, match=why):
            walk(spark, edges)
    elsewhere = [*fine, (50, 51, 0, 1.0), (51, 50, 0, 1.0), (51, None, 1, 1.0)]
    assert walk(spark, elsewhere) == by_recursion(fine)
    tangle = [(a, b, b, 1.0) for a in range(5) for b in range(5)]
    assert walk(spark, tangle, strict=False) == by_recursion(tangle)


def test_chain_of_thousands(spark):
    n = 3000
    rows = spark.range(n).select(F.lit("d").alias("drawing_id"), F.col("id").alias("parent_part_index"), (F.col("id") + 1).alias("target_part_index"), F.col("id").alias("owner_id"), F.lit(0).cast("long").alias("instance_index"), F.lit(False).alias("is_sheet"), F.lit(1.0).alias("dx"))
    shelf = Shelf()
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.cteRecursionLevelLimit")
    found = structure.occurrences(placed(rows), spark.createDataFrame([("d", 0)], "drawing_id string, part_index long"), shelf.put)
    total = found.agg(F.count("*"), F.max("depth"), F.sum(F.when(F.col("world.tx") == F.col("depth"), 1)), F.countDistinct("part_index")).first()
    assert tuple(total) == (n + 1, n, n + 1, n + 1)
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.cteRecursionLevelLimit"))
    shelf.clear()


def test_tenfold_sharing(spark):
    """Each part places the next ten times: a hundred thousand leaves from fifty placements."""
    edges = [(k, k + 1, i, float(10**k * i)) for k in range(5) for i in range(10)]
    found = walk(spark, edges)
    assert len(found) == sum(10**k for k in range(6))
    assert sorted(x for key, _, x in found if len(key) == 5) == [float(i) for i in range(100_000)]


def test_roots_of_ones_own(spark):
    data = drawing(section(5, asse(10, "Top", child(20, 1, 2)), asse(20, "Leaf")), section(6, "Top\n"), section(6, "Leaf\n"))
    corpus = sparkdraw.read(spark, spark.createDataFrame([("d", bytearray(data))], "drawing_id string, content binary"))
    root = spark.createDataFrame([("d", 1), ("d", 7)], "drawing_id string, part_index long")
    assert [(r.part_index, r.depth) for r in corpus.occurrences(root, strict=False).collect()] == [(1, 0)]
    found = corpus.occurrences(root)
    with pytest.raises(Exception, match="part 7 is no part of d"):
        found.count()
    assert corpus.occurrences(root.where("part_index = 1")).count() == 1


def test_modelspace_without_a_part(spark):
    data = drawing(section(1, "x\n"))
    df = spark.createDataFrame([("d", bytearray(data))], "drawing_id string, content binary")
    assert sparkdraw.read(spark, df).modelspace().count() == 0
    found = sparkdraw.read(spark, df, mode="FAILFAST").modelspace()
    with pytest.raises(Exception, match="d has no part"):
        found.count()
