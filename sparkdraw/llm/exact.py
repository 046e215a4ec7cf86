"""Exact duplicates by deterministic block naming.

Texts lose their white space and are cut into blocks of a fixed size. Sorting gives equal blocks equal
integer names; adjacent names are then paired and the pairs named in the same way, until each document
has one name. Names stand for the content itself, so two documents share an identity only if their
texts are equal: nothing rests on a hash.

Null texts count as empty, and all empty texts are equal. Of equal texts, the row with the most code
points in the original text stays, then the smallest id (null ids last); of repeated rows with one id,
one stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, owning, pieces, staged

#: Bytes of a block; bytes of blocks and number of places that a task gathers before it hands them on.
BLOCK, GATHERED, PLACES = 16384, 48 << 20, 50_000
WHITE = b" \t\n\v\f\r"


def _cut(df: DataFrame, id_type: T.DataType, block: int) -> DataFrame:
    """A row for each distinct block of a large piece of the input, with the places it stands at.

    A block that many documents have leaves a task about once, so it comes to the task that names it a few times a task, not a document.
    """
    place = T.StructType([
        T.StructField("rid", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("n", T.IntegerType()),
        T.StructField("doc_id", id_type), T.StructField("n_chars", T.IntegerType()), T.StructField("sha", T.StringType()),
    ])
    schema = T.StructType([T.StructField("piece", T.LongType()), T.StructField("idx", T.IntegerType()), T.StructField("block", T.BinaryType()), T.StructField("places", T.ArrayType(place))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number = row = held = count = 0
        seen: dict[bytes, list[dict]] = {}
        places_type = None

        def gathered() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array([part << 36 | number] * len(seen), pa.int64()), pa.array(range(len(seen)), pa.int32()), pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), places_type)],
                names=["piece", "idx", "block", "places"],
            )
            seen.clear()
            return out

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            places_type = pa.list_(pa.struct([("rid", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("doc_id", kind), ("n_chars", pa.int32()), ("sha", pa.string())]))
            for some in pieces(batch, "text"):
                for doc_id, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    text = text or ""
                    raw = text.encode("utf-8", "surrogatepass").translate(None, WHITE)
                    n = max(1, -(-len(raw) // block))
                    rid = part << 36 | row
                    row += 1
                    for pos in range(n):
                        first = pos == 0
                        at = seen.setdefault(raw[pos * block : (pos + 1) * block], [])
                        held += 0 if at else min(block, len(raw))
                        count += 1
                        at.append({
                            "rid": rid, "pos": pos, "n": n, "doc_id": doc_id if first else None,
                            "n_chars": len(text) if first else None, "sha": hashlib.sha256(raw).hexdigest() if first else None,
                        })
                    if held > GATHERED or count > PLACES:
                        yield gathered()
                        number, held, count = number + 1, 0, 0
        if seen:
            yield gathered()

    return df.mapInArrow(run, schema)


def _named(df: DataFrame, keys: list[str]) -> DataFrame:
    """df without its keys, with ``name``: equal keys have equal names, and no others.

    Rows are dealt by key and sorted; a name is the partition and the number of the run within it, so it
    depends on content alone and a task that runs again gives the same names.
    """
    rest = [c for c in df.columns if c not in keys]
    schema = T.StructType([*[df.schema[c] for c in rest], T.StructField("name", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, last = TaskContext.get().partitionId(), -1, None
        for batch in batches:
            names = []
            for key in zip(*[batch.column(k).to_pylist() for k in keys], strict=True):
                if key != last:
                    number, last = number + 1, key
                names.append(part << 40 | number)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(names, pa.int64())], names=[*rest, "name"])

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, and rid (a row number)."""
    base = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    cut = staged(_cut(base, base.schema["doc_id"].dataType, block), "blocks")
    names = _named(cut.select("piece", "idx", "block"), ["block"])
    placed = cut.select("piece", "idx", "places").join(names, ["piece", "idx"])
    level = staged(
        placed.select(F.explode("places").alias("p"), "name").select(
            "p.rid", "p.pos", F.col("p.n").alias("blocks"), F.col("p.n"),
            F.when(F.col("p.pos") == 0, F.struct("p.doc_id", "p.n_chars", "p.sha")).alias("info"), "name",
        ),
        "names",
    )
    discard(cut)
    levels, done = [level], [level.where("n = 1").select("rid", "blocks", "info", "name")]
    most = level.agg(F.max("n")).first()[0] or 1
    level = level.where("n > 1")
    while most > 1:
        even = F.col("pos") % 2 == 0
        pairs = level.groupBy("rid", "blocks", (F.col("pos") / 2).cast("int").alias("pos"), F.ceil(F.col("n") / 2).cast("int").alias("n")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"), F.max("info").alias("info")
        )
        pairs = staged(pairs, "pairs")
        kinds = pairs.select("a", "b").distinct().withColumns({"x": F.col("a"), "y": F.col("b")})
        named = _named(kinds, ["a", "b"])
        level = staged(pairs.join(named, (pairs.a == named.x) & (pairs.b == named.y)).select("rid", "blocks", "pos", "n", "info", "name"), "names")
        discard(pairs)
        levels.append(level)
        done.append(level.where("n = 1").select("rid", "blocks", "info", "name"))
        level, most = level.where("n > 1"), -(-most // 2)
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    rows = rows.select("rid", "blocks", "name", "info.*")
    best = F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("d"), F.col("rid").alias("r"))
    # Written out, so that the join below has a plain exchange on both sides and a hot group can be split.
    groups = staged(rows.groupBy("blocks", "name").agg(F.min(best).alias("best"), F.count("*").alias("group_size")), "groups")
    found = rows.join(groups, ["blocks", "name"]).select(
        "doc_id", F.col("best.d").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.r")).alias("kept"), F.col("sha").alias("text_sha256"), "rid"
    )
    out = staged(found, "exact")
    discard(*levels, groups)
    return out


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with its columns. Rows with one id and equal texts count as one row."""
    found = exact_duplicates(df, id_col, text_col)
    kept = found.where("kept").select(F.col("doc_id").alias("kept_id__"))
    out = df.join(kept, df[id_col].eqNullSafe(kept.kept_id__), "left_semi")
    if not found.groupBy("doc_id").count().where("count > 1").isEmpty():
        # Ids that repeat name several rows: deal with those rows by text.
        bare = F.translate(F.coalesce(F.col(text_col), F.lit("")), " \t\n\x0b\x0c\r", "")
        out = out.withColumn("bare__", F.sha2(bare.cast("binary"), 256))
        keep = found.where("kept").select(F.col("doc_id").alias("kept_id__"), F.col("text_sha256").alias("sha__")).distinct()
        out = out.join(keep, out[id_col].eqNullSafe(keep.kept_id__) & (out.bare__ == keep.sha__), "left_semi")
        out = out.dropDuplicates([id_col, "bare__"]).drop("bare__")
    return owning(out, found)
