"""Small drawings share batches of rows, and their framing is dealt out."""

import pyarrow as pa
import pytest
from drawing import drawing, rec, section
from pyspark.sql import functions as F

from sparkdraw import corpus
from sparkdraw.plans import features
from sparkdraw.sources import scan
from sparkdraw.sources.limits import Limits


class Kernel:
    """Stands for a DataFrame; keeps what would run over its batches."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self


def framed(contents, **options):
    columns = [pa.array([f"d{i}" for i in range(len(contents))]), pa.array(contents, pa.binary()), pa.array([len(x) for x in contents], pa.int64())]
    kernel = scan.scan(Kernel(), Limits(), False, **options)
    return list(kernel.run(iter([pa.RecordBatch.from_arrays(columns, names=["drawing_id", "content", "size"])])))


def key(row):
    return repr(sorted(row.items()))


def test_small_drawings_share_batches():
    """Of 3,000 drawings with a record, a remark or an error each, no row is lost and few batches are made."""
    contents = [(drawing(section(61, rec("P", i, 0, 0))), drawing(section(61, rec("P", i, 0, 0)), end=""), b"no drawing")[i % 3] for i in range(3000)]
    batches = framed(contents)
    rows = [r for b in batches for r in b.to_pylist()]
    count = lambda kind: sum(r["row"] == kind for r in rows)
    assert (count("drawing"), count("section"), count("record"), count("diagnostic")) == (3000, 2000, 2000, 1000)
    assert len(batches) <= 8


@pytest.mark.parametrize("bound", ["RECORDS_A_BATCH", "BYTES_A_BATCH"])
def test_batches_are_bounded(monkeypatch, bound):
    """Whatever ends a batch, rows are the same; a batch has no more rows than it may."""
    contents = [drawing(section(61, *[rec("P", j, i, 0) for j in range(i % 7)]), "#~1\n" * (i % 3)) for i in range(60)] + [b"", b"#~1\n" * 40]
    whole = framed(contents, range_size=100)
    monkeypatch.setattr(scan, bound, 5)
    cut = framed(contents, range_size=100)
    assert sorted(key(r) for b in whole for r in b.to_pylist()) == sorted(key(r) for b in cut for r in b.to_pylist())
    assert len(cut) > len(whole)
    if bound == "RECORDS_A_BATCH":
        assert max(sum(r["row"] == "record" for r in b.to_pylist()) for b in cut) <= 5


def test_customers_are_dealt_out(spark, tmp_path, monkeypatch):
    """Customers of one row group are framed by several tasks."""
    spark.range(400).select(F.col("id").alias("c_custkey"), F.lit("x").alias("c_name")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    seen, read = [], corpus.read
    monkeypatch.setattr(features.corpus, "read", lambda spark, source, *a, **b: seen.append(source) or read(spark, source, *a, **b))
    found = {r.outcome: r.n for r in features.q37_failures_stay_apart(spark, str(tmp_path)).collect()}
    over = sum(k % 4 == 3 and k % 7 > 3 for k in range(400))
    assert found == {"read": 200 - over, "InvalidDrawing": 100, "UnsupportedDrawing": 100, "LimitExceeded": over}
    assert seen[0].select(F.spark_partition_id()).distinct().count() >= 4
