"""Incremental ingest: new drawings become rows of the same tables.

A file arrives whole, so there is no state between batches and no late data; framing needs a drawing's
rows together, which foreachBatch gives. Each batch is written under its own number, so a batch that
runs again replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..corpus import Corpus, read
from ..sources.limits import Limits

FILES = "path string, modificationTime timestamp, length long, content binary"


def read_stream(
    spark: SparkSession, path: str, out: str, tables: Sequence[str] = ("drawings", "records", "entities", "diagnostics"), limits: Limits | None = None, encoding: str | None = None,
    glob: str | None = None, files_a_batch: int = 1000, available_now: bool = True,
) -> StreamingQuery:
    """Start a query that reads drawings as they arrive under ``path`` and writes ``out``/table/batch=N as Parquet."""
    if unknown := set(tables) - set(Corpus.TABLES):
        raise ValueError(f"no such table: {', '.join(sorted(unknown))}")
    source = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_a_batch)
    if glob:
        source = source.option("pathGlobFilter", glob)

    def write(batch: DataFrame, number: int) -> None:
        corpus = read(batch.sparkSession, batch.select(F.col("path").alias("drawing_id"), "content"), limits, encoding)
        try:
            for name in tables:
                getattr(corpus, name).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        finally:
            corpus.close()

    writer = source.load(path).writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/_progress")
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
