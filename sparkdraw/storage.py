"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only on a local master without that setting."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="sparkdraw-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Shelf:
    """Tables written once and read many times: plans stay small, and lost executors cost no rerun."""

    def __init__(self):
        self.paths: list[tuple[SparkSession, str]] = []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        spark = df.sparkSession
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append((spark, path))
        return spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Delete the tables; frames that read them are of no use afterwards."""
        for spark, path in self.paths:
            remove(spark, path)
        self.paths.clear()
