"""What registered queries share: the registry, tables, and reading of drawings written from them."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import corpus
from ..operators.resolve import KEY
from . import synth as S

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None):
    """Register a query, with the DuckDB SQL that says the same over the tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark: SparkSession, *parts: DataFrame, **options) -> corpus.Corpus:
    """A drawing that cannot be read fails the query, as its rows would be missing."""
    return corpus.read(spark, S.drawings(*parts, **options), mode="FAILFAST")


def many_drawings(key: Column) -> Column:
    """A drawing for each thousand keys, so that drawings keep their size as tables grow."""
    return F.floor(key / 1000)


def zipped(df: DataFrame) -> DataFrame:
    """Drawings in gzip envelopes."""

    def run(batches):
        for batch in batches:
            packed = [gzip.compress(x, 1, mtime=0) for x in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(KEY), pa.array(packed, pa.binary())], names=[KEY, "content"])

    return df.mapInArrow(run, "drawing_id string, content binary")
