"""The bounded training sample that both classifiers learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

#: Most labelled rows that a model learns from, chosen by a hash of the id.
SAMPLE = 20_000


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label) of at most ``sample`` labelled rows outside the held-out fold, one an id.

    Null ids, null labels and held-out ids are left out; an id with several labels counts by the largest,
    one with several texts by the least of them. The sample is broadcast: it has at most ``sample`` ids.
    """
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
