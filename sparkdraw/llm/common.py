"""Plumbing shared by the operators: Arrow passes over text, tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import remove, shared_dir

#: Most UTF-8 bytes of text that one call of a batch function gets, unless one row alone has more.
CHUNK_BYTES = 8 << 20
#: Most rows of an Arrow batch.
ARROW_ROWS = 2000
#: The share of documents held out of every training set is 1 / FOLDS.
FOLDS = 5


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ARROW_ROWS rows in this session, as rows are whole documents."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and lost executors cost no rerun."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_paths = [path]
    return out


def owning(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df, whose ``discard`` deletes those tables of ``staged`` that it reads."""
    df.staged_paths = [p for t in tables for p in t.__dict__.get("staged_paths", [])]
    return df


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``staged``, and those of frames that are ``owning`` some; frames that read them are of no use afterwards. Others are left alone."""
    for df in tables:
        for path in df.__dict__.get("staged_paths", []):
            remove(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo FOLDS; a null id counts as fold 1 (never held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(1))


def pieces(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no piece has over ``limit`` bytes of text, unless it has one row."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total + n > limit and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def with_arrow(
    df: DataFrame,
    column: str,
    fields: list[T.StructField],
    function: Callable[[list[str]], Iterable[pa.Array]],
) -> DataFrame:
    """Append ``fields`` to df, computed from the texts of ``column`` (null counts as empty).

    One narrow pass, no shuffle. Columns of df with a new field's name are replaced.
    ``function`` gets the texts of a bounded piece and returns one Arrow array per field.
    """
    bounded_batches(df.sparkSession)
    names = {f.name.lower() for f in fields}
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names or c == column])
    clash = column.lower() in names
    if clash:
        raise ValueError(f"{column} is both the text column and a result column")
    schema = T.StructType([*kept.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, column):
                texts = [t or "" for t in part.column(column).to_pylist()]
                new = list(function(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *[f.name for f in fields]])

    return kept.mapInArrow(run, schema)
