"""Near-duplicates by one-permutation MinHash with optimal densification.

A text's set has its distinct shingles of five words. One hash deals the set over BINS bins and keeps
the least value of each; an empty bin takes the value of the first filled bin in an order of its own.
Texts with equal sets form a class, and one member stands for it. BANDS bands of ROWS bins each name
buckets. A bucket's centre is the member that meets most others over all its buckets; edges run from
centres to members, so a bucket has fewer edges than members. Edges whose sketches could reach the
threshold are confirmed on the full sets, and confirmed links give components. Buckets that still hold
several components are worked through exactly: their members outside the bucket's largest component
are compared with all members of other components.

A pair at the threshold shares no bucket with probability (1 - 0.75**4)**32, about 5 in a million. Of
those that share one, sketches put aside no pair at the threshold while a set has under LARGE shingles;
larger pairs fail with one of less than one in a million, as unequal cells are spread no wider than a
binomial count. At 0.8 both are rarer still, and only links that hold two components together on their
own matter. Null texts and texts without words have an empty set and
link with nothing. A component's id is its smallest document id, null only if all are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, owning, pieces, staged
from .components import connected_components

SHINGLE = 5
BINS, BANDS, ROWS = 512, 32, 4
#: Links have 100 * intersection >= SHARE * union.
SHARE = 75
#: Sets of LARGE shingles and more are also put aside above so many unequal cells, over five standard deviations above the mean at the threshold.
LARGE, UNLIKE = 2 * BINS, 140
#: Odd multipliers of 64 bits: the golden ratio's, and the mixing constants of splitmix64.
_GOLD, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_POWERS = np.array([pow(_GOLD, i + 1, 1 << 64) for i in range(SHINGLE)], np.uint64)
_SIGS = [f"s{i}" for i in range(BINS // 32)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX2)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of the words of one piece of the input."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, memo: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    if n < SHINGLE:
        out = np.array([(h * _POWERS[:n]).sum(dtype=np.uint64) + np.uint64(n)])
    else:
        out = h[: n - SHINGLE + 1] * _POWERS[0]
        for i in range(1, SHINGLE):
            out += h[i : n - SHINGLE + 1 + i] * _POWERS[i]
    return np.unique(_mix(out))


def _orders() -> np.ndarray:
    """For each bin, the order in which it tries the bins."""
    rng = np.random.Generator(np.random.PCG64(20))
    return np.stack([rng.permutation(BINS) for _ in range(BINS)])


_ORDERS = _orders()
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed two-bit cells of a non-empty set; an empty bin's cell is 0."""
    starts = np.searchsorted(hashes >> _SHIFT, np.arange(BINS + 1, dtype=np.uint64))
    filled = starts[:-1] < starts[1:]
    values = hashes[np.minimum(starts[:-1], len(hashes) - 1)]
    states = np.where(filled, values % np.uint64(3) + np.uint64(1), np.uint64(0))
    if not filled.all():
        empty = np.flatnonzero(~filled)
        orders = _ORDERS[empty]
        values[empty] = values[orders[np.arange(len(empty)), filled[orders].argmax(axis=1)]]
    rows = values[: BANDS * ROWS].reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64) * np.uint64(_GOLD)
    for i in range(ROWS):
        keys = _mix(keys ^ rows[:, i]) + np.uint64(_GOLD)
    cells = states.reshape(-1, 32) << np.arange(0, 64, 2, dtype=np.uint64)
    return keys.view(np.int64), cells.sum(axis=1, dtype=np.uint64).view(np.int64)


def _name(hashes: bytes) -> bytes:
    return hashlib.blake2b(hashes, digest_size=16).digest()


def sketches(df: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, node, bands, cells) of df's doc_id and text, with df's other columns; node names the set."""
    others = [c for c in df.columns if c not in ("doc_id", "text")]
    schema = T.StructType([
        *[df.schema[c] for c in others], df.schema["doc_id"], T.StructField("n_shingles", T.LongType()), T.StructField("node", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("cells", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                memo, sizes, nodes, bands, cells = Words(), [], [], [], []
                for text in part.column("text").to_pylist():
                    found = shingles(text or "", memo)
                    sizes.append(len(found))
                    nodes.append(_name(found.tobytes()) if len(found) else None)
                    keys, packed = sketch(found) if len(found) else (None, None)
                    bands.append(keys)
                    cells.append(packed)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in others], part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(cells, pa.list_(pa.int64()))], names=schema.names
                )

    return df.mapInArrow(run, schema)


def _sets(df: DataFrame) -> DataFrame:
    """(node, hashes) of df's node and text; hashes are sorted 64-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                memo = Words()
                found = [shingles(t or "", memo).tobytes() for t in part.column("text").to_pylist()]
                # Documents that share an id can differ in text; the node tells which one is meant.
                own = pa.array([_name(h) == n for h, n in zip(found, part.column("node").to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("node").filter(own), pa.array(found, pa.binary()).filter(own)], names=["node", "hashes"])

    return df.mapInArrow(run, "node binary, hashes binary")


def _plausible(x: str, y: str) -> F.Column:
    """Whether sizes and sketches of two structs let a pair reach the threshold.

    Bins with unequal cells hold a shingle each that only one set has, and a pair at the threshold has
    at most (1 - t) / (1 + t) of its sizes' sum of those: this test loses no pair, whatever the sizes.
    """
    sizes = (F.col(f"{x}.n") * 100 >= F.col(f"{y}.n") * SHARE) & (F.col(f"{y}.n") * 100 >= F.col(f"{x}.n") * SHARE)
    unequal = _unequal_cells(x, y)
    possible = unequal * (100 + SHARE) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (100 - SHARE)
    return sizes & possible & ((F.least(f"{x}.n", f"{y}.n") < LARGE) | (unequal <= UNLIKE))


def _unequal_cells(x: str, y: str) -> F.Column:
    odd = F.lit(0x5555555555555555)
    unequal = F.lit(0)
    for s in _SIGS:
        diff = F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))
        unequal = unequal + F.bit_count(diff.bitwiseOR(F.shiftrightunsigned(diff, 1)).bitwiseAND(odd))
    return unequal


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                yes.append(100 * both >= SHARE * (len(x) + len(y) - both))
            keep = pa.array(yes, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    return _near_duplicates(df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")))


def _near_duplicates(given: DataFrame) -> DataFrame:
    """The same for doc_id and text, with the other columns of given."""
    docs, extra = given.select("doc_id", "text"), [c for c in given.columns if c not in ("doc_id", "text")]
    rows = staged(sketches(given), "sketches")
    # Aggregated before it is dealt out: a class can hold a third of all rows.
    found = rows.where("n_shingles > 0").groupBy("node")
    classes = staged(found.agg(F.min("doc_id").alias("lead"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "cells")]), "classes")
    sketch = classes.select("node", F.struct("node", F.col("n_shingles").alias("n"), *[F.col("cells")[i].alias(s) for i, s in enumerate(_SIGS)]).alias("s"))

    spread = classes.select("node", F.explode("bands").alias("band"))
    busy = spread.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    shared = staged(spread.join(busy, "band"), "members")
    central = shared.groupBy("node").agg(F.sum("members").alias("met"))
    members = staged(shared.select("band", "node").join(central, "node").select("band", "node", F.struct("met", "node").alias("m")), "members")
    discard(shared)

    # Stars: each member's best centre, one edge a member. Sketches join the pairs, not the buckets' rows.
    centres = members.groupBy("band").agg(F.max("m").alias("c"))
    pairs = members.join(centres, "band").where(F.col("node") != F.col("c.node")).select("node", F.col("c.node").alias("centre"), F.col("c.met").alias("met")).distinct()
    pairs = pairs.join(sketch.select("node", F.col("s").alias("m")), "node").join(sketch.select(F.col("node").alias("centre"), F.col("s").alias("c")), "centre").where(_plausible("m", "c"))
    stars = pairs.groupBy("node").agg(F.max(F.struct((-_unequal_cells("m", "c")).alias("cells"), "met", F.col("centre").alias("node"))).alias("best"))
    edges = staged(stars.select(F.least("node", "best.node").alias("a"), F.greatest("node", "best.node").alias("b")).distinct(), "edges")

    def sets_of(nodes: DataFrame, hint: str | None = None) -> DataFrame:
        """Sets of the classes in nodes, from the text of one document of each class."""
        # Written out, so that its size is known: without a hint Spark sends it to all tasks if it is under its threshold, and deals out texts if not.
        named = staged(classes.select("node", "lead").join(nodes, "node", "left_semi"), "leads")
        ids = named.hint(hint) if hint else named
        text = docs.join(ids, docs.doc_id.eqNullSafe(named.lead)).select("node", "text")
        out = staged(_sets(text), "sets")
        discard(named)
        return out

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()

    # These grow with the input, so texts are dealt out at every size; what is missing later are a few.
    sets = sets_of(ends(edges), "merge")
    links = staged(_confirmed(edges, sets), "links")
    labels = connected_components(links)

    # The exact way for buckets that still hold several components.
    placed = members.select("band", "node").join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("part"))
    parts = placed.groupBy("band", "part").agg(F.count("*").alias("k"))
    mixed = parts.groupBy("band").agg(F.max(F.struct("k", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    open_ = placed.join(mixed, "band").select("band", "node", "part", F.col("main.part").alias("main"))
    open_ = staged(open_.join(sketch, "node").join(classes.select("node", "bands"), "node").select("band", F.col("s").alias("m"), "part", "main", "bands"), "open")
    outside = open_.where("part <> main").select("band", F.col("m").alias("x"), F.col("part").alias("px"), F.col("bands").alias("bx"))
    others = open_.select("band", F.col("m").alias("y"), F.col("part").alias("py"), F.col("bands").alias("by"))
    # A pair comes from the first bucket that both are in, not from each.
    common = F.filter(F.zip_with("bx", "by", lambda a, b: F.when(a == b, a)), lambda v: v.isNotNull())
    more = outside.join(others, "band").where((F.col("px") != F.col("py")) & _plausible("x", "y") & (F.get(common, F.lit(0)) == F.col("band")))
    more = more.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    more = staged(more.join(edges, ["a", "b"], "left_anti"), "edges")
    discard(open_, members)
    spent = [edges, more, sets, links]
    if not more.isEmpty():
        missing = staged(ends(more).join(sets, "node", "left_anti"), "missing")
        if not missing.isEmpty():
            rest = sets_of(missing)
            spent.append(rest)
            sets = sets.unionByName(rest)
        found = staged(_confirmed(more, sets), "links")
        if not found.isEmpty():
            # Between components, so few: components of these join whole ones.
            side = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
            between = found.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
            joined = connected_components(between)
            both = labels.unionByName(ends(found).join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
            wide = both.join(joined.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
            spent.append(labels)
            labels = staged(wide, "labels")
            discard(joined)
        discard(missing, found)
    # By class, not by row, so that a text with many copies is one row here.
    marked = classes.select("node", "lead").join(labels, "node", "left").select("node", "lead", F.coalesce("label", "node").alias("label"))
    least = marked.groupBy("label").agg(F.min("lead").alias("least"))
    named = staged(marked.join(least, "label").select("node", "least"), "components")
    discard(*spent, labels, classes)
    out = rows.select(*extra, "doc_id", "n_shingles", "node").join(named, "node", "left").withColumn("component_id", F.coalesce("least", "doc_id"))
    out = staged(out.select(*extra, "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), "components")
    discard(rows, named)
    return out


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df whose id is the smallest of their component, with df's columns.

    Rows that share an id are told apart by their texts, as they can be of several components; rows that
    repeat both stay together.
    """
    text = F.col(f"`{text_col}`").cast("string")
    digest = F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    found = _near_duplicates(df.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), digest.alias("digest")))
    kept = found.where("kept").select(F.struct(F.col("doc_id").alias("id"), "digest").alias("kept_row__")).distinct()
    own = F.struct(F.col(f"`{id_col}`").alias("id"), digest.alias("digest"))
    return owning(df.join(kept.hint("merge"), own.eqNullSafe(kept.kept_row__), "left_semi"), found)
