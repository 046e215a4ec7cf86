"""Refusals and column names that a caller chooses."""

import pytest
from pyspark.sql import functions as F

from sparkdraw.llm import bpe, quality, toxicity


def test_ranks_beyond_twenty_bits_are_refused():
    ranks = {bytes([i]): i for i in range(256)}
    bpe.Bpe(ranks, r"\S+")
    for wrong in (1 << 20, -1):
        with pytest.raises(ValueError, match="2\\*\\*20"):
            bpe.Bpe(ranks | {b"ab": wrong}, r"\S+")


def test_results_can_stand_beside_columns_of_the_same_name(spark):
    df = spark.createDataFrame([(1, "a b c", 0.25)], "doc_id long, text string, quality double").withColumn("toxicity", F.lit("mine"))
    empty = df.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    row = quality.score(df, quality.fit(empty, labels), out_col="q").first()
    assert (row.quality, row.q) == (0.25, 0.5)
    row = toxicity.score(df, toxicity.fit(empty, labels), out_col="t", passages_col="p").first()
    assert row.toxicity == "mine" and 0 <= row.t < 0.5 and row.p == []
