"""Readings of fields: numbers that are too large, and fields that are read once."""

from drawing import drawing, rec, section, tex
from pyspark.sql import functions as F

import sparkdraw
from sparkdraw.functions.strict import finite
from sparkdraw.operators import decode


def test_finite_numbers(spark):
    """Numbers without an exponent that are too large stay out as those with one do."""
    rows = ["1e308", "1e309", "-1e999", "9" * 300, "9" * 301, "-" + "9" * 308 + ".5", "9" * 400, "." + "9" * 400, "+1.", ".", "1f", "1e5"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(finite(F.col("x"))).collect()]
    assert got == [1e308, None, None, float("9" * 300), float("9" * 301), -float("9" * 308 + ".5"), None, float("." + "9" * 400), 1.0, None, None, 1e5]


def test_matrix_is_read_once(spark):
    """A decoded TEX reads its fields in few places of the plan, not anew for each use."""
    corpus = sparkdraw.read(spark, spark.createDataFrame([("d", bytearray(drawing(section(62, rec(*tex(1, "x"))))))], "drawing_id string, content binary"))
    rows = decode.decode(corpus.records.where("record_type = 'TEX'"), {"TEX"}, sparse=True)
    plan = rows.select("text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_cast") < 60
    assert rows.select("text.text").first()[0] == "x"
