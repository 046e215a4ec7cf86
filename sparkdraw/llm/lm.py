"""Language-model scores by stupid backoff over n-grams of subword tokens.

A first pass counts pairs of adjacent tokens, which also gives the counts of single tokens. A second
explodes each block of documents into its trigrams and deals them by a hash of the trigram, a row per
block and partition, together with those counts of pairs that the partition's trigrams need. A
partition then holds a part of the table of trigram counts and all lower counts: an n-gram seen at
least ``cutoff`` times scores its count over the count of what precedes its last token; a rarer one
scores BACKOFF times its suffix's score. Joined to the block's trigrams, scores are summed by document
there, and sums come together by block.

Dealing goes by the middle token, so that a pair goes to few partitions; a frequent token is salted by
a hash of its neighbours, as many ways as its count asks for, and no token fills a partition. Partitions
get PART_TOKENS tokens each, so their number grows with the corpus. Terms are kept in units of
1 / UNIT: sums are whole numbers, the same in any order. Far beyond 300 TB, blocks of PIECE bytes hold
too few trigrams a partition; take larger ones there.

A document starts with two marks that only serve as context. Null texts count as empty; empty texts
have no tokens, a log-score of 0 and null perplexity. Repeated rows count as documents of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, owning, pieces, staged

#: Factor of a step down, and the id that stands for a document's start; ids are below it.
BACKOFF, START = 0.4, 0xFFFF
#: Tokens that a partition of the table is meant for, and parts of a log-score's unit.
PART_TOKENS, UNIT = 12_000_000, 1 << 24
#: Bytes of text of a block, and pairs that a task holds before it hands them on.
PIECE, HELD = 8 << 20, 2_000_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(29))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * _MIX[0]
    x = (x ^ (x >> _MIX[2])) * _MIX[1]
    return x ^ (x >> _MIX[2])


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers, by planes of bytes, compressed; their own lengths come first."""
    parts = [np.array([len(a) for a in arrays], np.uint32).tobytes()]
    parts += [a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays]
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    sizes, at, out = np.frombuffer(raw, np.uint32, len(kinds)).tolist(), 4 * len(kinds), []
    for n, kind in zip(sizes, map(np.dtype, kinds), strict=True):
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def _checked(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in one array, and each document's number of them."""
    sizes = np.array([len(x) for x in tokens], np.int64)
    flat = np.concatenate(tokens).astype(np.int64) if len(tokens) else np.zeros(0, np.int64)
    if len(flat) and not 0 <= flat.min() <= flat.max() < START:
        raise ValueError(f"token ids must be below {START}")
    return flat, sizes


def trigrams(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each position's trigram as 48 bits, the middle token highest, then the first and the last; and its document."""
    flat, sizes = _checked(tokens)
    first = np.cumsum(sizes) - sizes
    one, two = np.roll(flat, 1), np.roll(flat, 2)
    heads = first[sizes > 0]
    one[heads] = two[heads] = START
    two[first[sizes > 1] + 1] = START
    grams = one.astype(np.uint64) << np.uint64(32) | two.astype(np.uint64) << np.uint64(16) | flat.astype(np.uint64)
    return grams, np.repeat(np.arange(len(tokens), dtype=np.uint64), sizes)


def _pair_counts(df: DataFrame, tokenizer: Callable) -> DataFrame:
    """(pair, n): how often two tokens stand side by side, the first one highest; the marks at a document's start count as tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer()
        keys, counts, fresh = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        waiting = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            both = np.concatenate([keys, *[k for k, _ in fresh]])
            found, at = np.unique(both, return_inverse=True)
            return found, np.bincount(at, np.concatenate([counts, *[n for _, n in fresh]]), len(found)).astype(np.int64)

        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                grams, _ = trigrams(encode([t or "" for t in part.column("text").to_pylist()]))
                middle, last = grams >> np.uint64(32), grams & np.uint64(0xFFFF)
                pairs = (middle << np.uint64(16) | last).astype(np.int64)
                starts = int((middle == START).sum())
                found, n = np.unique(pairs, return_counts=True)
                fresh += [(found, n), (np.array([START << 16 | START]), np.array([starts]))] if starts else []
                waiting += len(found)
                if waiting > max(len(keys), HELD // 4):
                    keys, counts = merged()
                    fresh, waiting = [], 0
                    if len(keys) > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])
                        keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        for a in range(0, len(keys), 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + (1 << 20)]), pa.array(counts[a : a + (1 << 20)])], names=["pair", "n"])

    found = df.select("text").mapInArrow(run, "pair long, n long")
    return found.groupBy("pair").agg(F.sum("n").alias("n"))


class Dealing:
    """Where trigrams and pairs go."""

    def __init__(self, counts: np.ndarray, parts: int):
        self.parts = parts
        self.ways = np.maximum(1, -(-counts * 4 // PART_TOKENS)).astype(np.uint64)

    def part(self, middle: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return (_mixed(middle << np.uint64(32) | salt) % np.uint64(self.parts)).astype(np.int64)

    def of_trigrams(self, grams: np.ndarray) -> np.ndarray:
        middle = grams >> np.uint64(32)
        return self.part(middle, _mixed(grams & np.uint64(0xFFFFFFFF)) % self.ways[middle])

    def of_pairs(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of a pair, partition) for all partitions that can have the pair's trigrams."""
        places, parts = [], []
        for middle in (pairs >> np.uint64(16), pairs & np.uint64(0xFFFF)):
            ways = self.ways[middle]
            place = np.repeat(np.arange(len(pairs)), ways.astype(np.int64))
            salt = np.arange(len(place)) - np.repeat(np.cumsum(ways.astype(np.int64)) - ways.astype(np.int64), ways.astype(np.int64))
            places.append(place)
            parts.append(self.part(middle[place], salt.astype(np.uint64)))
        both = np.unique(np.concatenate(parts) << 40 | np.concatenate(places))
        return both & ((1 << 40) - 1), both >> 40


def _cuts(parts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, start, end) of each run of a sorted array."""
    if len(parts):
        ends = np.append(np.flatnonzero(parts[1:] != parts[:-1]) + 1, len(parts)).tolist()
        for a, b in zip([0, *ends], ends):  # noqa: B905
            yield int(parts[a]), a, b


_GRAMS, _PAIRS, _HEADS = 0, 1, 2


def _dealt(schema: T.StructType, kind: pa.DataType, part: list[int], what: int, block: list[int], data: list[bytes | None], ids: list | None = None, sizes: list | None = None) -> pa.RecordBatch:
    n = len(part)
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array([what] * n, pa.int32()), pa.array(block, pa.int64()), pa.array(data, pa.binary()), pa.array(ids or [None] * n, pa.list_(kind)), pa.array(sizes or [None] * n, pa.list_(pa.int64()))],
        names=schema.names,
    )


def _term(grams: np.ndarray, n: np.ndarray, keys: np.ndarray, above: np.ndarray, one: np.ndarray, order: int, cutoff: int) -> np.ndarray:
    """Log-score of each trigram that occurs n times; keys and above are pairs and their counts, one the counts of single tokens."""
    middle, first, last = grams >> np.uint64(32), grams >> np.uint64(16) & np.uint64(0xFFFF), grams & np.uint64(0xFFFF)

    def count(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return above[np.searchsorted(keys, a << np.uint64(16) | b)]

    out = np.log(one[last] / one[:START].sum())
    if order > 1:
        pair = count(middle, last)
        out = np.where(pair >= cutoff, np.log(pair / one[middle]), math.log(BACKOFF) + out)
    if order > 2:
        out = np.where(n >= cutoff, np.log(n / count(first, middle)), math.log(BACKOFF) + out)
    return np.rint(out * UNIT)


def stupid_backoff(df: DataFrame, tokenizer: Callable, order: int = 3, cutoff: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, log_score (natural log), perplexity. Orders 1 to 3."""
    if not 1 <= order <= 3:
        raise ValueError("order must be 1, 2 or 3")
    spark = df.sparkSession
    bounded_batches(spark)
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    pairs = staged(_pair_counts(docs, tokenizer), "pairs")
    # At most 2**16 rows: a count for each token of the vocabulary.
    singles = np.zeros(START + 1, np.int64)
    for r in pairs.groupBy(F.col("pair").bitwiseAND(START).alias("token")).agg(F.sum("n").alias("n")).toLocalIterator():
        singles[r["token"]] = r["n"]
    tokens = int(singles[:START].sum())
    parts = max(1, -(-tokens // PART_TOKENS), min(tokens // 100_000, spark.sparkContext.defaultParallelism))
    shared = spark.sparkContext.broadcast((singles, Dealing(singles, parts)))
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("what", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("data", T.BinaryType()),
        T.StructField("ids", T.ArrayType(id_type)), T.StructField("sizes", T.ArrayType(T.LongType())),
    ])
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(id_type)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, block, (_, dealing) = tokenizer(), TaskContext.get().partitionId() << 24, shared.value
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                texts = encode([t or "" for t in piece.column("text").to_pylist()])
                grams, docs_of = trigrams(texts)
                keys = np.sort(grams << np.uint64(16) | docs_of)  # three tokens and a document fill 64 bits
                at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
                times, keys = np.diff(np.append(at, len(keys))).astype(np.uint32), keys[at]
                grams = keys >> np.uint64(16)
                at = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, np.int64)
                many, grams = np.diff(np.append(at, len(grams))).astype(np.uint32), grams[at]
                goal = dealing.of_trigrams(grams)
                # By partition; within one, trigrams keep their order and so do a trigram's documents.
                by = np.argsort(goal, kind="stable")
                entry = np.argsort(np.repeat(goal, many), kind="stable")
                goal, grams, many = goal[by], grams[by], many[by]
                members, times = (keys[entry] & np.uint64(0xFFFF)).astype(np.uint16), times[entry]
                ends = np.concatenate(([0], np.cumsum(many.astype(np.int64))))
                part, data = [], []
                for p, a, b in _cuts(goal):
                    x, y = int(ends[a]), int(ends[b])
                    some = grams[a:b]
                    part.append(p)
                    data.append(_packed((some >> np.uint64(32)).astype(np.uint16), (some & np.uint64(0xFFFFFFFF)).astype(np.uint32), many[a:b], members[x:y], times[x:y]))
                yield _dealt(schema, kind, part, _GRAMS, [block] * len(part), data)
                yield _dealt(schema, kind, [block % parts], _HEADS, [block], [None], [piece.column("doc_id").to_pylist()], [[len(x) for x in texts]])
                block += 1

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, dealing = shared.value
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            pair = np.concatenate([b.column("pair").to_numpy() for b in held]).astype(np.uint64)
            n = np.concatenate([b.column("n").to_numpy() for b in held]).astype(np.uint64)
            held.clear()
            place, goal = dealing.of_pairs(pair)
            made = [(p, _packed(pair[place[a:b]].astype(np.uint32), n[place[a:b]])) for p, a, b in _cuts(goal)]
            return _dealt(schema, kind, [p for p, _ in made], _PAIRS, [0] * len(made), [d for _, d in made])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) > HELD // 4:
                yield out()
        if held:
            yield out()

    summed = T.StructType(schema.fields[2:])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = shared.value[0].astype(float)
        keys, above, blocks, bodies = [], [], [], []
        for batch in batches:
            what = batch.column("what").to_numpy()
            heads = batch.filter(pa.array(what == _HEADS))
            if len(heads):
                yield heads.select(summed.names)
            for w, block, data in zip(what.tolist(), batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if w == _PAIRS:
                    some, n = _unpacked(data, "<u4", "<u8")
                    keys.append(some.astype(np.uint64))
                    above.append(n)
                elif w == _GRAMS:
                    blocks.append(block)
                    bodies.append(data)
        if not blocks:
            return
        by, at = np.unique(np.concatenate(keys), return_index=True)
        above = np.concatenate(above)[at].astype(float)
        shape = ("<u2", "<u4", "<u4", "<u2", "<u4")
        all_grams, all_n = [], []
        for data in bodies:
            high, low, many, _, times = _unpacked(data, *shape)
            all_grams.append(high.astype(np.uint64) << np.uint64(32) | low)
            all_n.append(np.add.reduceat(times, np.concatenate(([0], np.cumsum(many.astype(np.int64))[:-1])), dtype=np.int64))
        sizes = [len(g) for g in all_grams]
        grams, place = np.unique(np.concatenate(all_grams), return_inverse=True)
        del all_grams
        n = np.bincount(place, np.concatenate(all_n), len(grams))
        terms = _term(grams, n, by, above, one, order, cutoff)[place]
        a = 0
        for block, data, size in zip(blocks, bodies, sizes, strict=True):
            _, _, many, members, times = _unpacked(data, *shape)
            sums = np.bincount(members, np.repeat(terms[a : a + size], many) * times)  # whole numbers below 2**53
            docs_at = np.unique(members)
            a += size
            body = _packed(docs_at, (-sums[docs_at]).astype(np.int64).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([body], pa.binary()), pa.nulls(1, pa.list_(kind)), pa.nulls(1, pa.list_(pa.int64()))], names=summed.names)

    rows = docs.mapInArrow(explode, schema).unionByName(pairs.mapInArrow(spread, schema)).repartitionById(parts, F.col("part")).mapInArrow(score, summed)
    result = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_tokens", T.LongType()), T.StructField("total", T.LongType())])

    def close(group: pa.Table) -> pa.Table:
        head = group.filter(group.column("sizes").is_valid())
        ids, sizes = head.column("ids")[0].values, head.column("sizes")[0].values
        total = np.zeros(len(sizes), np.int64)
        for data in group.column("data").to_pylist():
            if data is not None:
                members, sums = _unpacked(data, "<u2", "<u8")
                total[members] -= sums.view(np.int64)
        return pa.table({"doc_id": ids.cast(kind), "n_tokens": sizes.cast(pa.int64()), "total": pa.array(total)})

    out = rows.groupBy("block").applyInArrow(close, result)
    log_score = F.col("total") / float(UNIT)
    perplexity = F.when(F.col("n_tokens") > 0, F.round(F.exp(-log_score / F.col("n_tokens")), 6))
    return owning(out.select("doc_id", "n_tokens", F.round(log_score, 6).alias("log_score"), perplexity.alias("perplexity")), pairs)
