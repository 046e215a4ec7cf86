"""Byte-level BPE with a hierarchical-bitmap rank queue.

Every pre-token of a batch is one stretch of a shared linked list. A bucket per merge rank holds the
list positions whose pair has that rank; a three-level bitmap says which buckets are occupied, and
find-first-set names the next rank in three steps. Positions whose pair has changed since they were
queued are stale and are skipped when their bucket is emptied. A bucket is emptied as a whole with
array operations, so that a batch costs about as many steps as it meets ranks; pre-tokens in which
a merge makes a pair of a lower rank than its own while their bucket still has work are done again
one merge at a time by the same queue.

Null texts count as empty; empty texts have no ids.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import with_arrow


class RankBitmap:
    """Set of small integers; the least one is found by find-first-set on three levels of 64-bit words."""

    def __init__(self, size: int):
        self.low = [0] * (size // 64 + 1)
        self.mid = [0] * (size // 4096 + 1)
        self.top = 0

    def add(self, r: int) -> None:
        self.low[r >> 6] |= 1 << (r & 63)
        self.mid[r >> 12] |= 1 << (r >> 6 & 63)
        self.top |= 1 << (r >> 12)

    def discard(self, r: int) -> None:
        self.low[r >> 6] &= ~(1 << (r & 63))
        if not self.low[r >> 6]:
            self.mid[r >> 12] &= ~(1 << (r >> 6 & 63))
            if not self.mid[r >> 12]:
                self.top &= ~(1 << (r >> 12))

    def first(self) -> int:
        """The least member, or -1."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        b = a << 6 | (self.mid[a] & -self.mid[a]).bit_length() - 1
        return b << 6 | (self.low[b] & -self.low[b]).bit_length() - 1


class Bpe:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.size = max(ranks.values()) + 1
        if not 0 <= min(ranks.values()) < self.size <= 1 << 20:
            raise ValueError("ranks must lie between 0 and 2**20")
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, made = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    made.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys = np.array(keys, np.int64)[order]
        self.pair_ranks = np.array(made, np.int32)[order]

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or -1."""
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def encode_one(self, piece: bytes) -> list[int]:
        """One pre-token, one merge at a time: lowest rank first, leftmost among equals."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        tok = [self.ranks[piece[i : i + 1]] for i in range(n)]
        nxt, prv, now = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        queue, buckets = RankBitmap(self.size), defaultdict(list)

        def enter(i: int) -> None:
            j = nxt[i]
            r = self.ranks.get(self.bytes_of[tok[i]] + self.bytes_of[tok[j]], -1) if j < n else -1
            now[i] = r
            if r >= 0:
                heapq.heappush(buckets[r], i)
                queue.add(r)

        for i in range(n - 1):
            enter(i)
        while (r := queue.first()) >= 0:
            bucket = buckets[r]
            i = heapq.heappop(bucket)
            if not bucket:
                queue.discard(r)
            if now[i] != r:
                continue  # stale
            j = nxt[i]
            tok[i], nxt[i], now[j] = r, nxt[j], -1
            if nxt[j] < n:
                prv[nxt[j]] = i
            enter(i)
            if prv[i] >= 0:
                enter(prv[i])
        out, i = [], 0
        while i < n:
            out.append(tok[i])
            i = nxt[i]
        return out

    def encode_pieces(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each word has."""
        whole = [self.ranks.get(w, -1) for w in words]
        ids = np.array(whole, np.int32)
        todo = np.flatnonzero(ids < 0)
        counts = np.ones(len(words), np.int64)
        if not len(todo):
            return ids, counts
        made, sizes = self._merge([words[i] for i in todo.tolist()])
        counts[todo] = sizes
        starts = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        known = ids >= 0
        flat[starts[known]] = ids[known]
        flat[np.repeat(starts[todo] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(made))] = made
        return flat, counts

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(w) for w in words], np.int64)
        tok = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(tok)
        owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        nxt = np.arange(1, n + 1, dtype=np.int32)
        ends = np.cumsum(lengths) - 1
        ends = ends[lengths > 0]
        nxt[ends] = -1
        prv = np.arange(-1, n - 1, dtype=np.int32)
        prv[ends[:-1] + 1] = -1
        if n:
            prv[0] = -1
        now = np.full(n, -1, np.int32)
        alive = np.ones(n, bool)
        redo = np.zeros(len(words), bool)
        queue, buckets = RankBitmap(self.size), {}

        def enter(at: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            firsts = np.concatenate(([0], cuts))
            for r, a, b in zip(ranks[firsts].tolist(), firsts.tolist(), [*cuts.tolist(), len(at)], strict=True):
                if r in buckets:
                    buckets[r].append(at[a:b])
                else:
                    buckets[r] = [at[a:b]]
                    queue.add(r)

        first = np.flatnonzero(nxt >= 0)
        now[first] = self.pair(tok[first], tok[first + 1])
        first = first[now[first] >= 0]
        if len(first):
            enter(first, now[first])
        while (r := queue.first()) >= 0:
            queue.discard(r)
            held = buckets.pop(r)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            at = at[now[at] == r]  # the others are stale
            if not len(at):
                continue
            after = nxt[at]
            if len(at) > 1:
                meets = after[:-1] == at[1:]
                if meets.any():  # of pairs that share a token, the leftmost goes first
                    place = np.arange(len(at))
                    begins = np.concatenate(([True], ~meets))
                    at = at[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
                    after = nxt[at]
            beyond = nxt[after]
            tok[at], nxt[at] = r, beyond
            alive[after], now[after], now[at] = False, -1, -1
            has = beyond >= 0
            prv[beyond[has]] = at[has]
            before = prv[at]
            left = before[before >= 0]
            near = np.concatenate((at[has], left))
            if not len(near):
                continue
            near.sort()
            if len(near) > 1:
                near = near[np.concatenate(([True], near[1:] != near[:-1]))]
            fresh = self.pair(tok[near], tok[nxt[near]])
            now[near] = fresh
            if (fresh[fresh >= 0] < r).any():
                inverted = np.unique(owner[near[(fresh >= 0) & (fresh < r)]])
                whose, times = np.unique(owner[at], return_counts=True)
                redo[np.intersect1d(inverted, whose[times > 1])] = True
            near, fresh = near[fresh >= 0], fresh[fresh >= 0]
            if len(near):
                enter(near, fresh)
        sizes = np.bincount(owner[alive], minlength=len(words))
        flat = tok[alive]
        if redo.any():
            rows = np.split(flat, np.cumsum(sizes)[:-1])
            for i in np.flatnonzero(redo).tolist():
                rows[i] = np.array(self.encode_one(words[i]), np.int32)
            sizes = np.array([len(x) for x in rows])
            flat = np.concatenate(rows)
        return flat, sizes

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit arrays."""
        index: dict[str, int] = defaultdict()
        index.default_factory = index.__len__
        rows = []
        for text in texts:
            found = self.split(text)
            rows.append(np.fromiter(map(index.__getitem__, found), np.int64, len(found)))
        flat, counts = self.encode_pieces([w.encode("utf-8", "surrogatepass") for w in index])
        starts = np.cumsum(counts) - counts
        out = []
        for row in rows:
            n = counts[row]
            total = int(n.sum())
            at = np.repeat(starts[row] - (np.cumsum(n) - n), n) + np.arange(total)
            out.append(flat[at].astype("<u4"))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Bpe:
    """The encoder for a rank file (lines of base64 token and rank), once per worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Bpe(ranks, pattern)


def encode(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text") -> DataFrame:
    """df with ``ids`` (binary: little-endian unsigned 32-bit) and ``decoded`` (binary)."""

    def run(texts: list[str]):
        model = load(vocabulary, pattern)
        ids = model.encode_batch(texts)
        yield pa.array([x.tobytes() for x in ids], pa.binary())
        yield pa.array([model.decode(x) for x in ids], pa.binary())

    return with_arrow(df, text_col, [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())], run)


def decode_ids(ids: list[int], model: Bpe) -> bytes:
    """The bytes of a list of ids."""
    return b"".join(chain(map(model.bytes_of.__getitem__, ids)))
