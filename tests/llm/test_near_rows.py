"""Near-duplicates among rows that share ids."""

from sparkdraw.llm import neardup


def test_rows_that_share_an_id_are_told_apart(spark):
    """A near copy goes though another row with its id stays; columns with names of helpers are kept."""
    w, v = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(3, w, 1), (5, w + " word", 2), (5, v, 3), (9, v + " word", 4), (5, v, 5), (None, "nobody's own text here", 6), (None, w + " end", 7), (8, None, 8), (8, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    kept = neardup.drop_near_duplicates(df)
    assert kept.columns == ["doc_id", "text", "digest"]
    assert sorted(r.digest for r in kept.collect()) == [1, 3, 5, 6, 8, 9]
