"""Prefix tries of conversations, as succinct level-order tries.

Conversations that begin with the same turns share nodes. Nodes with more than MEMBERS conversations are
heavy: these upper levels are told apart by names of prefixes (hash chains of turns) and merged by
aggregations. What hangs below a heavy node is light, and lies in one shard. There numpy builds the trie
level by level as a LOUDS bitvector with an array of labels; ranks in the bitvector give parents, and one
pass from the last level to the first (``add.at``) sums members, leaves and tokens. The tops of shards
then add to all heavy nodes above them.

A conversation is a row, so its turns are read in one task, and a shard has at most MEMBERS conversations
a top. The ids that end at a node are hashed in order: sorted by ranges over all tasks, written as pieces,
and fed piece by piece to the hash, so memory stays bounded however many they are.

Null ids belong to no conversation; null roles and texts are empty. Conversations without turns end at the
root. Without conversations there is no node.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, discard, owning, staged

#: Most conversations of a node that lies in a shard.
MEMBERS = 200
#: Conversations that share a task, as a mean.
SHARD = 1000
ROOT = b""

_NODE = T.StructType([T.StructField(n, T.LongType()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [T.StructField("ends_sha256", T.StringType())])
_TOPS = T.StructType([*_NODE, T.StructField("above", T.ArrayType(T.BinaryType()))])
_EMPTY = hashlib.sha256(b"").hexdigest()


class Louds:
    """A trie as a bitvector of child counts in unary, level by level, and a label for each node.

    Node 0 is above all tops. Nodes have numbers in level order; ``levels`` has the first number of each
    level and, last, the count of nodes. ``last`` is the node at which each path ends.
    """

    def __init__(self, tops: np.ndarray, flat: np.ndarray, sizes: np.ndarray):
        """Paths: a top each, then ``sizes`` labels each from ``flat``; all are numbers from 0."""
        count = len(sizes)
        starts = np.cumsum(sizes) - sizes
        width = int(max(tops.max(initial=-1), flat.max(initial=-1))) + 1
        labels, parents, at = [np.array([-1])], [np.array([-1])], np.zeros(count, np.int64)
        self.levels = [0, 1]
        going = np.arange(count)
        depth = 0
        while len(going):
            own = tops[going] if depth == 0 else flat[starts[going] + depth - 1]
            # Sorted by parent, then label: the order of the level.
            names, number = np.unique(at[going] * width + own, return_inverse=True)
            at[going] = self.levels[-1] + number
            parents.append(names // width)
            labels.append(names % width)
            self.levels.append(self.levels[-1] + len(names))
            going = going[sizes[going] > depth]
            depth += 1
        self.labels, self.last = np.concatenate(labels), at
        n = self.levels[-1]
        children = np.bincount(np.concatenate(parents)[1:], minlength=n)
        self.bits = np.zeros(2 * n - 1, bool)
        # Each node's ones come before its zero.
        self.bits[np.arange(n - 1) + np.repeat(np.arange(n), children)] = True

    def parents(self) -> np.ndarray:
        """For each node the zeros before its own one; -1 for node 0."""
        ones = np.flatnonzero(self.bits)
        return np.concatenate(([-1], ones - np.arange(len(ones))))

    def children(self) -> np.ndarray:
        """The ones between two zeros."""
        return np.diff(np.flatnonzero(~self.bits), prepend=-1) - 1

    def up(self, values: np.ndarray, ufunc: np.ufunc = np.add) -> np.ndarray:
        """Totals over each node's subtree, from the last level to the first."""
        total, parent = values.copy(), self.parents()
        for begin, end in reversed(list(zip(self.levels[1:-1], self.levels[2:], strict=True))):
            ufunc.at(total, parent[begin:end], total[begin:end])
        return total


def _joined(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values get equal numbers."""
    found = column.combine_chunks().dictionary_encode()
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _shard(table: pa.Table) -> pa.Table:
    """Nodes of the light subtrees of one shard."""
    table = table.combine_chunks()
    lists = table.column("labels")
    sizes = np.diff(lists.chunk(0).offsets.to_numpy())
    conv = table.column("conv_id").to_numpy()
    tops = _numbers(table.column("top"))
    trie = Louds(tops, _numbers(pa.chunked_array([lists.chunk(0).flatten()])), sizes)
    n = trie.levels[-1]
    words = np.zeros(n, np.int64)
    parent, children = trie.parents(), trie.children()
    # The words of a node's own turn, from any path that goes through it: walk all paths up together.
    starts = np.cumsum(sizes) - sizes
    counts = table.column("words").chunk(0).flatten().to_numpy()
    first = table.column("first_words").to_numpy()
    node, left = trie.last.copy(), sizes.copy()
    going = np.arange(len(sizes))
    while len(going):
        deep = left[going] > 0
        words[node[going]] = np.where(deep, counts[np.minimum(starts[going] + left[going] - 1, len(counts) - 1)] if len(counts) else 0, first[going])
        going = going[deep]
        node[going] = parent[node[going]]
        left[going] -= 1
    members = trie.up(np.bincount(trie.last, minlength=n))
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, trie.last, conv)
    least = trie.up(least, np.minimum)
    leaves = trie.up((children == 0).astype(np.int64))
    saved = trie.up((members - 1) * words)
    ends = np.full(n, _EMPTY, object)
    order = np.lexsort((conv, trie.last))
    edges = np.flatnonzero(np.diff(trie.last[order], prepend=-1))
    for some in np.split(order, edges[1:]) if len(order) else ():
        ends[trie.last[some[0]]] = _joined(conv[some])
    # Node 0 stands for the heavy nodes above; the tops know theirs by a member of their own.
    member = np.zeros(trie.levels[2], np.int64)
    _, some = np.unique(tops, return_index=True)
    member[1:] = some
    top = np.zeros(n, bool)
    top[1 : trie.levels[2]] = True
    base = table.column("depth").to_numpy()
    level = np.repeat(np.arange(len(trie.levels) - 1), np.diff(trie.levels))
    owner = np.zeros(n, np.int64)
    owner[1 : trie.levels[2]] = member[1:]
    for begin, end in zip(trie.levels[2:-1], trie.levels[3:], strict=True):
        owner[begin:end] = owner[parent[begin:end]]
    over = np.where(top, table.column("parent_conv_id").to_numpy()[owner], least[np.maximum(parent, 0)])
    above = table.column("above").to_pylist()
    columns = [least, base[owner] + level, over, members, children, leaves, saved]
    return pa.table(
        [*[pa.array(c[1:], pa.int64()) for c in columns], pa.array(ends[1:], pa.string()), pa.array([above[o] if t else None for o, t in zip(owner[1:].tolist(), top[1:].tolist(), strict=True)], pa.list_(pa.binary()))],
        names=_TOPS.names,
    )


def conversations(rows: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns) of rows that are turns: null orders first, ties by role, then text, with nulls as empty. Rows without an id are left out."""
    turn = F.struct(F.col(order).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    packed = rows.where(F.col(conv).isNotNull()).groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return packed.withColumn("turns", F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))))


def _named(convs: DataFrame) -> DataFrame:
    """(conv_id, names, labels, words): of each turn the name of the prefix that ends with it, its own name, and its count of words."""
    binary = T.ArrayType(T.BinaryType())
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("names", binary), T.StructField("labels", binary), T.StructField("words", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, out = batch.column("turns"), ([], [], [])
            said = turns.flatten()
            pairs = zip(*[[(x or "").encode("utf-8", "surrogatepass") for x in said.field(k).to_pylist()] for k in ("role", "text")], strict=True)
            for size in pc.list_value_length(turns).fill_null(0).to_pylist():
                own, name = ([], [], []), b""
                for role, text in itertools.islice(pairs, size):
                    label = hashlib.blake2b(b"%d:%b%b" % (len(role), role, text), digest_size=16).digest()
                    name = hashlib.blake2b(name + label, digest_size=16).digest()
                    for some, value in zip(own, (name, label, len(text.split())), strict=True):
                        some.append(value)
                for some, value in zip(out, own, strict=True):
                    some.append(value)
            kinds = (pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *[pa.array(v, k) for v, k in zip(out, kinds, strict=True)]], names=schema.names)

    return convs.select(F.col("conv_id").cast("long").alias("conv_id"), "turns").where("conv_id is not null").mapInArrow(run, schema)


def _ends(rows: DataFrame) -> DataFrame:
    """(name, n_ends, ends_sha256) of rows (name, conv_id): the hash of each name's ids in order."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, conv = batch.column("name"), batch.column("conv_id").to_numpy()
            cuts = np.flatnonzero(np.diff(_numbers(pa.chunked_array([name])), prepend=-1)) if len(conv) else np.zeros(0, np.int64)
            parts = np.split(conv, cuts[1:]) if len(conv) else []
            yield pa.RecordBatch.from_arrays(
                [name.take(pa.array(cuts)), pa.array([int(p[0]) for p in parts], pa.int64()), pa.array([len(p) for p in parts], pa.int64()), pa.array([",".join(map(str, p.tolist())) for p in parts], pa.string())],
                names=["name", "low", "n", "ids"],
            )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, total, state = None, 0, None

        def told():
            return pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([total], pa.int64()), pa.array([state.hexdigest()])], names=["name", "n_ends", "ends_sha256"])

        for batch in batches:
            for one, n, ids in zip(*[batch.column(c).to_pylist() for c in ("name", "n", "ids")], strict=True):
                if one != name:
                    if state is not None:
                        yield told()
                    name, total, state = one, 0, hashlib.sha256()
                state.update((("," if total else "") + ids).encode())
                total += n
        if state is not None:
            yield told()

    cut = rows.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(pieces, "name binary, low long, n long, ids string")
    return cut.repartition("name").sortWithinPartitions("name", "low").mapInArrow(hashed, "name binary, n_ends long, ends_sha256 string")


def prefix_trie(convs: DataFrame, members: int = MEMBERS, shard: int = SHARD) -> DataFrame:
    """One row a node of the trie of convs (conv_id, each once; turns: array of role and text).

    conv_id: the smallest member; depth; parent_conv_id: the parent's conv_id, null for the root; n_convs:
    members; n_children; n_leaves: childless nodes of the subtree; saved_tokens: over the subtree, words
    of each node's last text for every member but one; ends_sha256: of the ids that end at the node.
    """
    bounded_batches(convs.sparkSession)
    paths = staged(_named(convs), "paths")
    total, first = paths.agg(F.count("*"), F.min("conv_id")).first()
    if not total:
        return owning(paths.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in _NODE]), paths)
    steps = paths.select("conv_id", F.posexplode("names").alias("at", "name"))
    heavy = staged(steps.groupBy("name").agg(F.count("*").alias("n"), F.min("conv_id").alias("first")).where(F.col("n") > members), "heavy")
    node = F.struct((F.col("at") + 1).cast("long").alias("depth"), "name", "n", "first")
    held = steps.join(heavy, "name").groupBy("conv_id").agg(F.array_sort(F.collect_list(node)).alias("held"))
    root = F.array(F.struct(F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("name"), F.lit(total).cast("long").alias("n"), F.lit(first).cast("long").alias("first")))
    rows = paths.join(held, "conv_id", "left").withColumn("held", F.concat(root, F.coalesce("held", F.slice(root, 1, 0)))).withColumn("depth", F.size("held") - 1)
    rows = staged(rows, "rows")
    lowest = F.element_at("held", -1)
    above = F.transform("held", lambda h: h["name"])

    light = rows.where(F.size("names") > F.col("depth"))
    top = F.get("names", F.col("depth"))
    rest = lambda c: F.slice(c, F.col("depth") + 2, F.size(c))
    light = light.select(
        F.pmod(F.xxhash64(top), F.lit(max(1, total // shard))).alias("shard"), top.alias("top"), "conv_id", F.col("depth").cast("long").alias("depth"), lowest["first"].alias("parent_conv_id"),
        F.get("words", F.col("depth")).alias("first_words"), rest("labels").alias("labels"), rest("words").alias("words"), above.alias("above"),
    )
    nodes = staged(light.groupBy("shard").applyInArrow(_shard, _TOPS), "nodes")

    # A heavy node is told by its smallest member.
    each = rows.select("conv_id", "words", above.alias("above"), F.posexplode("held").alias("at", "h")).where("conv_id = h.first")
    heads = each.select(
        F.col("h.name").alias("name"), "conv_id", "h.depth", F.col("h.n").alias("n_convs"), F.slice("above", F.lit(1), F.col("at")).alias("above"),
        F.when(F.col("at") > 0, (F.col("h.n") - 1) * F.get("words", F.col("at") - 1)).otherwise(0).cast("long").alias("own"), F.get("above", F.col("at") - 1).alias("parent"),
    )
    over = heads.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = _ends(rows.where(F.size("names") == F.col("depth")).select(lowest["name"].alias("name"), "conv_id"))
    heads = staged(heads.join(ends, "name", "left"), "heads")
    leaf = (F.coalesce("n_ends", F.lit(0)) == F.col("n_convs")).cast("long")
    one = lambda names, leaves, saved: (F.explode(names).alias("name"), leaves.alias("n_leaves"), saved.alias("saved_tokens"))
    sums = nodes.where("above is not null").select(*one(F.col("above"), F.col("n_leaves"), F.col("saved_tokens")))
    sums = sums.unionByName(heads.select(*one(F.array_append("above", F.col("name")), leaf, F.col("own"))))
    sums = sums.groupBy("name").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    below = nodes.where("above is not null").select(F.element_at("above", -1).alias("name")).unionByName(heads.where("parent is not null").select(F.col("parent").alias("name")))
    below = below.groupBy("name").agg(F.count("*").alias("n_children"))
    upper = heads.join(sums, "name").join(below, "name", "left").join(over, "parent", "left")
    upper = upper.withColumns({"n_children": F.coalesce("n_children", F.lit(0)).cast("long"), "ends_sha256": F.coalesce("ends_sha256", F.lit(_EMPTY))})
    out = staged(nodes.select(*_NODE.names).unionByName(upper.select(*_NODE.names)), "trie")
    discard(paths, heavy, rows, nodes, heads)
    return out
