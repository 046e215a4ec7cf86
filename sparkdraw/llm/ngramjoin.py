"""Jaccard similarity join of texts by shingles, filtered under several global orders of tokens.

A text's set has its distinct shingles of four words. Under any order of all tokens, two sets that reach
the threshold share a token among the first n - ceil(t n) + 1 of each: their prefixes. ORDERS orders put
seldom tokens first, each by other counters, so prefixes differ from order to order. Prefix tokens of the
first order name buckets; pairs that meet there, and whose sizes and places let them reach the threshold,
are candidates. Sketches of the sets, a bit for a hash or two, put aside most that fall short of the
threshold. Sets are built for the rest alone: pairs whose prefixes do not also meet under every other order
are dropped, what is left is verified on the full sets. No step loses a linked pair: each filter is a
necessary condition, whatever the orders are. The counters are LOADS slots an order that tokens are hashed to, so their size is fixed
(tokens that share a slot only make an order less sharp), and they cover all rows.

Texts with equal sets form a class with one row in all further steps. ``near_copies`` links buckets first
by stars: every member has one candidate at most, the best of its buckets' centres. Buckets that still hold
several components are then joined between components, which is exact: a pair within a component needs no
check to know the components. ``similar_pairs`` verifies every candidate.

Null texts and texts without words have an empty set and link with nothing. A text with fewer words than a
shingle has one shingle of all of them. Rows repeat as they are; a component's id is its smallest document
id, null only if all are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, discard, owning, pieces, staged
from .components import connected_components
from .neardup import Words, _mix, _name

SHINGLE = 4
#: Links have 100 * intersection >= SHARE * union.
SHARE = 85
#: Bits of a filter of keys, a power of two: more keys make it less sharp, not larger.
BITS = 1 << 24
#: Orders, and the slots of each order's counters: a power of two.
ORDERS, LOADS = 3, 1 << 17
_GOLD = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(_GOLD, i + 1, 1 << 64) for i in range(SHINGLE)], np.uint64)
_TURNS = np.array([1, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_SHIFT = np.uint64(64 - LOADS.bit_length() + 1)


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


def _slots(hashes: np.ndarray, order: int) -> np.ndarray:
    return ((hashes * _TURNS[order]) >> _SHIFT).astype(np.int64)


def prefix(hashes: np.ndarray, loads: np.ndarray, order: int) -> np.ndarray:
    """The first tokens of a set under an order: by the load of their slot, then by hash."""
    n = len(hashes)
    first = n - (SHARE * n + 99) // 100 + 1
    return hashes[np.argsort(loads[order][_slots(hashes, order)], kind="stable")[:first]]


def sketch(hashes: np.ndarray) -> bytes:
    """A bit a slot: whether an odd number of the set's hashes fall there. Slots are a power of two, as many as hashes at least."""
    slots = max(64, 1 << (len(hashes) - 1).bit_length())
    found = np.zeros(slots, np.uint8)
    np.add.at(found, (hashes & np.uint64(slots - 1)).astype(np.int64), np.uint8(1))
    return np.packbits(found & np.uint8(1)).tobytes()


def unshared(x: np.ndarray, y: np.ndarray) -> int:
    """So many hashes at least are in one of two sets only, by their sketches as 64-bit words: a hash that both have changes no bit between them."""
    x, y = sorted((x, y), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def loads(docs: DataFrame) -> np.ndarray:
    """ORDERS rows of LOADS counters over the sets of all texts; this many numbers reach the driver, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ORDERS, LOADS), np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                memo = Words()
                found = [shingles(t or "", memo) for t in part.column("text").to_pylist()]
                flat = np.concatenate([*found, np.zeros(0, np.uint64)])
                for k in range(ORDERS):
                    total[k] += np.bincount(_slots(flat, k), minlength=LOADS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total.ravel()[used], pa.int64())], names=["slot", "n"])

    sums = docs.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(ORDERS * LOADS, np.int64)
    out[sums.column("slot").to_numpy()] = sums.column("n").to_numpy()
    return out.reshape(ORDERS, LOADS)


def _read(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, n_shingles, name, first, sketch): name and sketch are the set's, first its prefix under the first order."""
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, t) for n, t in (("n_shingles", T.LongType()), ("name", T.BinaryType()), ("first", T.ArrayType(T.LongType())), ("sketch", T.BinaryType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in pieces(batch, "text"):
                memo = Words()
                found = [shingles(t or "", memo) for t in part.column("text").to_pylist()]
                firsts = [prefix(h, known, 0).view(np.int64) if len(h) else None for h in found]
                names, sketches = (pa.array([f(h) if len(h) else None for h in found], pa.binary()) for f in (lambda h: _name(h.tobytes()), sketch))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(h) for h in found], pa.int64()), names, pa.array(firsts, pa.list_(pa.int64())), sketches], names=schema.names)

    return docs.mapInArrow(run, schema)


def _sets(docs: DataFrame, shared, bitmap) -> DataFrame:
    """(doc_id, name, filters, hashes) of docs (key, doc_id, text) whose key the filter does not rule out: shortened tokens of the prefixes under the other orders, and the set."""
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, t) for n, t in (("name", T.BinaryType()), ("filters", T.ArrayType(T.ArrayType(T.IntegerType()))), ("hashes", T.BinaryType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            batch = batch.filter(pa.array(_has(bitmap.value, batch.column("key").to_numpy().view(np.uint64)), pa.bool_()))
            for part in pieces(batch, "text"):
                memo = Words()
                found = [shingles(t or "", memo) for t in part.column("text").to_pylist()]
                filters = [[prefix(h, known, k).astype(np.uint32).view(np.int32) for k in range(1, ORDERS)] if len(h) else None for h in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([_name(h.tobytes()) for h in found], pa.binary()), pa.array(filters, pa.list_(pa.list_(pa.int32()))), pa.array([h.tobytes() for h in found], pa.binary())], names=schema.names
                )

    return docs.mapInArrow(run, schema)


def _filter(keys: DataFrame, key: Column):
    """A broadcast bitmap with a bit for each of the 64-bit hashes ``key``: BITS bits reach the driver, however many keys there are."""
    slot = key.bitwiseAND(F.lit(BITS - 1))
    word = F.shiftright(slot, 6).cast("int").alias("word")
    bits = keys.select(word, F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(BITS - 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _kept(classes: DataFrame, bitmap) -> DataFrame:
    """(node, n, at, token) of prefix tokens that the filter does not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column("first")
            flat = first.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = np.diff(first.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = np.flatnonzero(_has(bitmap.value, flat))
            row = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([batch.column("node").take(row), batch.column("n").take(row), pa.array(at[keep], pa.int32()), pa.array(flat[keep].view(np.int64))], names=["node", "n", "at", "token"])

    return classes.select("node", "n", "first").mapInArrow(run, "node long, n int, at int, token long")


def _plausible(x: str, y: str) -> F.Column:
    """Whether two sets can reach the threshold if this is the first token that they share: what follows it in either is all they can have in common."""
    left = F.least(F.col(f"{x}.n") - F.col(f"{x}.at"), F.col(f"{y}.n") - F.col(f"{y}.at"))
    return left * (100 + SHARE) >= (F.col(f"{x}.n") + F.col(f"{y}.n")) * SHARE


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches let them reach the threshold."""
    side = lambda end: classes.select(F.col("node").alias(end), F.col("n").alias(f"{end}_n"), F.col("sketch").alias(f"{end}_sketch"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(f"{end}_sketch")] for end in "ab")
            least = np.array([unshared(x, y) for x, y in zip(*sketches, strict=True)], np.int64)
            both = batch.column("a_n").to_numpy().astype(np.int64) + batch.column("b_n").to_numpy()
            # Of sizes that add up to ``both``, less unshared hashes leave a larger intersection and a smaller union.
            keep = pa.array(least * (100 + SHARE) <= both * (100 - SHARE), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(end).filter(keep) for end in "ab"], names=["a", "b"])

    # Sketches are dealt out by node, then with the pair.
    return pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared, total) of the pairs (a, b) that meet under every other order and reach the threshold."""
    side = lambda end, *more: sets.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in more])
    meet = F.lit(True)
    for k in range(ORDERS - 1):
        meet = meet & F.arrays_overlap(F.get("a_filters", F.lit(k)), F.get("b_filters", F.lit(k)))
    left = pairs.hint("merge").join(side("a", "filters"), "a").hint("merge").join(side("b", "filters"), "b").where(meet).select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, total = [], []
            for x, y in zip(batch.column("a_hashes"), batch.column("b_hashes"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                shared.append(both)
                total.append(len(x) + len(y) - both)
            keep = pa.array(100 * np.array(shared, np.int64) >= SHARE * np.array(total, np.int64), pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array(total, pa.int64()))], names=["a", "b", "shared", "total"])

    return left.hint("merge").join(side("a", "hashes"), "a").hint("merge").join(side("b", "hashes"), "b").mapInArrow(run, "a long, b long, shared long, total long")


class _Join:
    """Classes of df's texts and the buckets that they meet in."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str):
        spark = df.sparkSession
        bounded_batches(spark)
        self.docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
        self.shared = spark.sparkContext.broadcast(loads(self.docs))
        self.rows = staged(_read(self.docs, self.shared), "rows")
        # Aggregated before it is dealt out: a class can hold a third of all rows.
        found = self.rows.where("n_shingles > 0").groupBy("name")
        found = found.agg(F.min("doc_id").alias("lead"), F.first("n_shingles").cast("int").alias("n"), F.first("first").alias("first"), F.first("sketch").alias("sketch"))
        # Numbers stay as they are once the table is written. Prefixes go once they are dealt out.
        wide = staged(found.withColumn("node", F.monotonically_increasing_id()), "classes")
        self.rows, spent = staged(self.rows.select("doc_id", "n_shingles", "name"), "rows"), self.rows
        discard(spent)
        busy = staged(wide.select(F.explode("first").alias("token")).groupBy("token").agg(F.count("*").alias("members")).where("members > 1").select("token"), "busy")
        bitmap = _filter(busy, F.col("token"))
        met = _kept(wide, bitmap).join(busy.hint("merge"), "token")
        # ``before`` is the last token before this one that others have too.
        own = Window.partitionBy("node")
        met = met.withColumns({"met": F.count("*").over(own), "before": F.lag("token").over(own.orderBy("at"))})
        self.members = staged(met.select("token", F.struct("met", "node", "n", "at", "before").alias("m")), "members")
        bitmap.unpersist()
        self.classes = staged(wide.select("node", "name", "lead", "n", "sketch"), "classes")
        discard(busy, wide)

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """Sets of the classes in nodes, from the text of one document of each class."""
        named = staged(self.classes.select("node", "name", "lead").join(nodes, "node", "left_semi"), "leads")
        bitmap = _filter(named, F.xxhash64("lead"))
        found = _sets(self.docs.select(F.xxhash64("doc_id").alias("key"), "doc_id", "text"), self.shared, bitmap)
        # Documents that share an id can differ in text, and a row can repeat.
        # Both sides grow with the input, so sets are dealt out at every size.
        out = found.join(named.hint("merge"), "name").where(F.col("doc_id").eqNullSafe(F.col("lead"))).select("node", "filters", "hashes")
        out = staged(out, "sets")
        bitmap.unpersist()
        discard(named)
        return out

    def between(self, left: DataFrame, right: DataFrame, apart) -> DataFrame:
        """Plausible pairs (a, b) of left (token, x) and right (token, y), each once.

        If the tokens before are the same too, the pair has met there: it is told where a common stretch begins.
        """
        begins = ~F.coalesce(F.col("x.before") == F.col("y.before"), F.lit(False))
        pairs = left.join(right, "token").where(apart & begins & _plausible("x", "y"))
        return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()

    def close(self) -> None:
        discard(self.classes, self.members)
        self.shared.unpersist()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id that links lead to)."""
    join = _Join(df, id_col, text_col)
    members, classes = join.members, join.classes

    centres = members.groupBy("token").agg(F.max("m").alias("c"))
    pairs = members.join(centres.hint("merge"), "token").where((F.col("m.node") != F.col("c.node")) & _plausible("m", "c"))
    pairs = pairs.groupBy(F.col("m.node").alias("node"), F.col("c.node").alias("centre")).agg(F.count("*").alias("common"), F.max("c.met").alias("met"))
    best = pairs.groupBy("node").agg(F.max(F.struct("common", "met", "centre")).alias("best"))
    edges = staged(best.select(F.least("node", "best.centre").alias("a"), F.greatest("node", "best.centre").alias("b")).distinct(), "edges")
    near = staged(_possible(edges, classes), "near")
    sets = join.sets_of(_ends(near))
    links = staged(_verified(near, sets).select("a", "b"), "links")
    discard(near, sets)
    labels = connected_components(links)

    # Pairs between components of a bucket; its largest component is compared with the others, not with itself.
    placed = members.select("token", "m", F.col("m.node").alias("node")).join(labels.hint("merge"), "node", "left").select("token", "m", F.coalesce("label", "node").alias("part"))
    parts = placed.groupBy("token", "part").agg(F.count("*").alias("k"))
    mixed = parts.groupBy("token").agg(F.max(F.struct("k", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("token", "main.part")
    mixed = mixed.withColumnRenamed("part", "main")
    open_ = staged(placed.join(mixed.hint("merge"), "token"), "open")
    outside = open_.where("part <> main").select("token", F.col("m").alias("x"), F.col("part").alias("px"))
    others = open_.select("token", F.col("m").alias("y"), F.col("part").alias("py"))
    more = join.between(outside, others, F.col("px") != F.col("py")).join(edges, ["a", "b"], "left_anti")
    more = staged(_possible(more, classes), "near")
    discard(open_)
    spent = [edges, more, links, labels]
    if not more.isEmpty():
        rest = join.sets_of(_ends(more))
        found = staged(_verified(more, rest).select("a", "b"), "links")
        discard(rest)
        spent.append(found)
        if not found.isEmpty():
            # Between components, so few: components of these join whole ones.
            side = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
            across = found.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
            joined = connected_components(across)
            both = labels.unionByName(_ends(found).join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
            labels = staged(both.join(joined.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
            spent += [labels, joined]
    # By class, not by row, so that a text with many copies is one row here.
    marked = classes.select("node", "name", "lead").join(labels, "node", "left").select("name", "lead", F.coalesce("label", "node").alias("label"))
    least = marked.groupBy("label").agg(F.min("lead").alias("least"))
    named = staged(marked.join(least, "label").select("name", "least"), "components")
    discard(*spent)
    join.close()
    out = join.rows.select("doc_id", "n_shingles", "name").join(named, "name", "left")
    out = staged(out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id")), "components")
    discard(join.rows, named)
    return out


def similar_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every link between classes, and the classes: (a, b, shared, total) with a < b, and (doc_id, n_shingles, class_id), whose id is the smallest of the texts with its set.

    Copies are not expanded into pairs; texts without a set have a null class.
    """
    join = _Join(df, id_col, text_col)
    x, y = (join.members.select("token", F.col("m").alias(end)) for end in "xy")
    edges = staged(_possible(join.between(x, y, F.col("x.node") < F.col("y.node")), join.classes), "near")
    sets = join.sets_of(_ends(edges))
    lead = lambda end: join.classes.select(F.col("node").alias(end), F.col("lead").alias(f"{end}_lead"))
    links = _verified(edges, sets).join(lead("a"), "a").join(lead("b"), "b")
    links = staged(links.select(F.least("a_lead", "b_lead").alias("a"), F.greatest("a_lead", "b_lead").alias("b"), "shared", "total").distinct(), "pairs")
    own = join.rows.join(join.classes.select("name", F.col("lead").alias("class_id")), "name", "left").select("doc_id", "n_shingles", "class_id")
    own = staged(own, "classes")
    discard(edges, sets, join.rows)
    join.close()
    return owning(links, links), owning(own, own)
