"""Drawings that queries write keep their size as tables grow, and none is lost silently."""

import pytest
from pyspark.sql import functions as F

from sparkdraw.plans import queries as Q


class Stop(Exception):
    pass


@pytest.mark.parametrize("name", ["q01_line_geometry", "q07_arc_angles", "q12_part_ownership", "q23_dimension_refs", "q30_symbol_components"])
def test_drawings_stay_bounded(spark, tmp_path, monkeypatch, name):
    """20,000 orders and suppliers: no drawing has more than a thousand, and a limit fails the query."""
    keys = spark.range(20_000)
    keys.select(F.col("id").alias("o_orderkey"), F.lit(1).alias("o_custkey"), F.lit(2.0).alias("o_totalprice")).write.parquet(f"{tmp_path}/orders.parquet")
    keys.select(F.col("id").alias("s_suppkey"), (F.col("id") % 3).alias("s_nationkey"), F.lit(2.0).alias("s_acctbal")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(i, f"NATION {i}") for i in range(4)], "n_nationkey long, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    seen = []

    def read(spark, source, **options):
        seen.append((source, options))
        raise Stop

    monkeypatch.setattr(Q.corpus, "read", read)
    with pytest.raises(Stop):
        Q.QUERIES[name](spark, str(tmp_path))
    (source, options), = seen
    found = source.select(F.size(F.split(F.col("content").cast("string"), r"\|~")).alias("records")).agg(F.count("*").alias("n"), F.max("records").alias("most")).first()
    # q12 has a drawing of nations besides.
    assert found.n == 20 + (name == "q12_part_ownership") and found.most <= 4 * 1000 + 1
    assert options.get("mode") == "FAILFAST"
