"""The corpus pipeline: toxicity, exact copies, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result to the shared
folder and reads it again as the next stage's docs. All stages but the last return docs' columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdraw.llm import exact, neardup, packing, secrets, toxicity
from sparkdraw.llm.common import discard, staged, table

#: A document at or above this probability goes.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less likely than not to be toxic, with all their columns."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    if not {"toxicity", "passages"} & {c.lower() for c in docs.columns}:
        return toxicity.score(docs, model).where(F.col("toxicity") < TOXIC).select(*names)
    # Columns with a result's name would be replaced, so they wait in a struct.
    rows = docs.select("text", F.struct(*names).alias("row__"))
    return toxicity.score(rows, model).where(F.col("toxicity") < TOXIC).select("row__.*")


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space."""
    return exact.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the smallest id."""
    return neardup.drop_near_duplicates(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark; n_chars follows the text."""
    clean = secrets.redact_secrets(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    tokenizer = packing.byte_level_tokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    packed = packing.pack(docs, tokenizer, end_token=2)
    return packed.select("doc_id", "piece", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact), ("minhash_near_dedup", drop_near), ("secret_scans", redact), ("best_fit_packing", pack)]

#: SQL can express neither the learned model nor the packing; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order, over the whole of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        last, docs = docs, staged(made, name)
        discard(last, made)
    return STAGES[-1][1](spark, docs, sf_dir)
