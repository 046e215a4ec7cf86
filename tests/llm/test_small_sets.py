"""Near copies of few shingles, at the threshold."""

from pyspark.sql import functions as F

from sparkdraw.llm import neardup


def test_small_sets_at_the_threshold(spark):
    """3 of 4, 6 of 8 and 9 of 12 shingles in common, 400 pairs each."""
    rows = []
    for i in range(400):
        for kind, n in enumerate((7, 11, 13)):
            words = [f"w{kind}x{i}x{j}" for j in range(n)]
            other = {7: [*words, "more"], 11: [*words[:-1], "last"], 13: [*words, "and", "three", "more"]}[n]
            rows += [(10 * i + 2 * kind, " ".join(words)), (10 * i + 2 * kind + 1, " ".join(other))]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.where(F.col("component_id") != F.floor(F.col("doc_id") / 2) * 2).count() == 0
    assert out.groupBy(F.floor(F.col("doc_id") % 10 / 2).alias("kind")).agg(F.sum(F.col("kept").cast("int")).alias("n")).orderBy("kind").collect() == [(0, 400), (1, 400), (2, 400)]
