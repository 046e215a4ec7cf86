"""Packing of documents into sequences by vector best-fit.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared lengths). A
piece goes where all three hold; among those sequences the choice is by the weighted dot product of
the piece and what is left (largest first), or by the weighted norm of what would be left (smallest).
Pieces go in from the largest to the smallest, window by window; sequences that are still open at a
window's end stay open for the next one.

A first round packs each partition of the input by itself, in one narrow pass without a shuffle. Its
sequences that end with REOPEN tokens of room or more, a few a partition, are opened again: their pieces are dealt
evenly to groups of AGAIN each and packed once more, so the number of sequences does not grow with the
number of partitions. The first round is written out, as both it and the second read it.

Null texts count as empty: such a document is its end token alone. Repeated rows are packed as rows of
their own.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import owning, pieces, staged


#: Room, in parts of a sequence's tokens, from which a sequence is opened again at the end of the first round; pieces of a group of the second.
REOPEN, AGAIN = 1 / 64, 2048


@dataclass(frozen=True)
class Capacity:
    """Limits of a sequence, weights of the three in the choice, rule ("norm" or "dot"), window and open sequences."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.02, 0.02)
    rule: str = "norm"
    window: int = 16_384
    open_sequences: int = 16_384

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], float)


class Packer:
    """Sequences under construction; ``add`` places a window of pieces."""

    def __init__(self, capacity: Capacity):
        self.capacity = capacity
        self.full = capacity.vector()
        self.scale = np.array(capacity.weights) / self.full**2
        self.left = np.empty((0, 3))  # what is left of each open sequence
        self.ids = np.empty(0, np.int64)
        self.made = 0
        self.set_aside: set[int] = set()  # sequences with room that gave way to emptier ones

    def add(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece; a piece must fit an empty sequence."""
        cap, n = self.capacity, len(lengths)
        room = len(self.left)
        left = np.concatenate((self.left, np.full((n, 3), -1.0)))
        ids = np.concatenate((self.ids, np.full(n, -1)))
        sequence, offset = np.empty(n, np.int64), np.empty(n, np.int64)
        # Of equal pieces the later rows go later, so the result depends on the rows' order alone.
        for i in np.argsort(-lengths, kind="stable").tolist():
            size = float(lengths[i])
            need = np.array([size, 1.0, size * size])
            best = -1
            if size < cap.tokens and room:
                rest = left[:room] - need
                fits = np.flatnonzero((rest >= 0).all(axis=1))
                if len(fits):
                    if cap.rule == "norm":
                        best = int(fits[(rest[fits] ** 2 @ self.scale).argmin()])
                    else:
                        best = int(fits[(left[fits] @ (self.scale * need)).argmax()])
            if best < 0:
                if (need > self.full).any():
                    raise ValueError(f"a piece of {size:.0f} tokens exceeds an empty sequence")
                best = room
                left[best], ids[best] = self.full, self.made
                room, self.made = room + 1, self.made + 1
            sequence[i], offset[i] = ids[best], cap.tokens - left[best, 0]
            left[best] -= need
            if left[best, 0] < 1 or left[best, 1] < 1 or left[best, 2] < 1:  # filled: nothing fits any more
                room -= 1
                left[best], ids[best] = left[room], ids[room]
        self.left, self.ids = left[:room], ids[:room]
        room_enough = self.left[:, 0] >= cap.tokens * REOPEN
        self.left, self.ids = self.left[room_enough], self.ids[room_enough]
        order = np.argsort(self.left[:, 0], kind="stable")[::-1]  # the emptiest stay open
        self.set_aside |= set(self.ids[order[cap.open_sequences :]].tolist())
        self.left, self.ids = self.left[order[: cap.open_sequences]], self.ids[order[: cap.open_sequences]]
        return sequence, offset


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of ``most`` tokens but the first, which has the rest."""
    first = (n - 1) % most + 1
    return [(0, first), *[(s, most) for s in range(first, n, most)]]


def pack(
    df: DataFrame, tokenizer: Callable[[], Callable[[list[str]], list[np.ndarray]]], end_token: int, capacity: Capacity = Capacity(),
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids (binary: little-endian unsigned 32-bit), sequence_id, offset.

    ``tokenizer`` makes, on a worker, the function from texts to arrays of ids.
    """
    base = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("doc_id", base.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ])

    def made(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = (kind, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=schema.names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, base_id = tokenizer(), Packer(capacity), TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        waiting: dict[int, list[tuple]] = {}  # rows of open sequences
        kind = None

        def placed() -> pa.RecordBatch:
            sequence, offset = packer.add(np.array([r[3] for r in held], np.int64))
            for row, q, at in zip(held, sequence.tolist(), offset.tolist(), strict=True):
                waiting.setdefault(q, []).append((*row, base_id + q, at))
            held.clear()
            still = set(packer.ids.tolist())
            done = [r for q in list(waiting) if q not in still for r in given(q)]
            return made(done, kind)

        def given(q: int) -> list[tuple]:
            rows = waiting.pop(q)
            return [(*r[:5], None, None) for r in rows] if q in packer.set_aside else rows

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for part in pieces(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(texts), strict=True):
                    ids = np.append(ids, end_token).astype("<u4")
                    held += [(doc_id, k, s, n, ids[s : s + n].tobytes()) for k, (s, n) in enumerate(cut(len(ids), capacity.tokens))]
                    if len(held) >= capacity.window:
                        yield placed()
        if held:
            yield placed()
        packer.set_aside |= set(waiting)
        for a in range(0, len(names := list(waiting)), 2000):
            yield made([r for q in names[a : a + 2000] for r in given(q)], kind)

    def again(key: tuple, group: pa.Table) -> pa.Table:
        packer = Packer(capacity)
        sequence, offset = packer.add(group.column("length").to_numpy())
        base_id = 1 << 62 | key[0].as_py() << 32
        out = group.select(schema.names[:5])
        return out.append_column("sequence_id", pa.array(sequence + base_id)).append_column("offset", pa.array(offset))

    rows = staged(base.mapInArrow(first, schema), "packed", compression="zstd")
    open_ = rows.where("sequence_id is null")
    groups = -(-open_.count() // AGAIN)
    packed = rows.where("sequence_id is not null")
    if not groups:
        return owning(packed, rows)
    # Places in a written table, so that a task that runs again deals the same way.
    dealt = open_.withColumn("deal", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return owning(packed.unionByName(dealt.groupBy("deal").applyInArrow(again, schema)), rows)


@lru_cache(maxsize=2)
def _ranked(path: str, pattern: str):
    import tiktoken

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    letters = _byte_letters()
    special = {t["content"]: t["id"] for t in whole.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in token): i for token, i in whole["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_tokenizer(path: str, pattern: str):
    """A tokenizer factory for a byte-level vocabulary in JSON form whose ids are merge ranks.

    For such a file the ids are those of the tokenizers library with add_special_tokens=False, which
    still reads the added tokens of the file inside a text, at several times its speed.
    """

    def make():
        model = _ranked(path, pattern)
        special = model.special_tokens_set

        def encode(texts: list[str]) -> list[np.ndarray]:
            return [np.array(model.encode(t, allowed_special="all") if any(s in t for s in special) else model.encode_ordinary(t), np.uint32) for t in texts]

        return encode

    return make
