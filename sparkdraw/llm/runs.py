"""Periodic runs of words by Main and Lorentz's divide and conquer.

A run is a stretch of words whose smallest period is q (words q apart are identical), at least LEAST words
and two periods long, that no neighbouring word extends. All texts of a batch form one stream of interned
word ids, parted by ids that occur once, so no repetition crosses texts. The stream is halved again and
again; a repetition crosses the midpoint of some node. There, two Z-functions give for each shift how far
words agree from the midpoint forwards and backwards, and a shift whose agreements span a period is a
repetition. It is extended both ways, intervals are told apart, and each keeps its smallest period.

Most midpoints have no repetition. A screen finds them for all nodes of a level at once: of agreements that
span a period q (or 12 - q words, if q is under 6) one side has half, so windows of that many words, as
differences of prefix sums of hashes, must be equal at the shift. Equal words give equal sums: the screen
leaves out no repetition, and what it lets through by chance is settled by the Z-functions.

Null, empty and blank texts have no words and no runs. A text is read in one task.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import with_arrow

#: Fewest words of a run.
LEAST = 12
#: Z-functions of so many items are found by array operations over all places at once, longer ones in linear time.
SMALL = 256
#: The smallest half of a node: a window of LEAST words lies in no smaller node.
LEAF = 8
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def z_function(s: list[int]) -> list[int]:
    """For each place, how many items from there on equal the first items; 0 at place 0."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def agreements(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The Z-function of pattern over text: how many items of each stretch of text equal the pattern's first. Text ends as the last whole stretch does."""
    r = len(pattern)
    if r <= SMALL:
        return np.logical_and.accumulate(np.lib.stride_tricks.sliding_window_view(text, r) == pattern, axis=1).sum(axis=1)
    return np.array(z_function([*pattern.tolist(), None, *text.tolist()])[r + 1 : len(text) + 2])


def _windows(mixed: np.ndarray, width: int, prefix: np.ndarray, back: np.ndarray) -> np.ndarray:
    """A hash of the ``width`` items from each place on."""
    n = len(mixed)
    out = np.zeros(n, np.uint64)
    out[: n - width + 1] = (prefix[width:] - prefix[: n - width + 1]) * back[: n - width + 1]
    return out


def _midpoints(ids: np.ndarray, margin: int) -> dict[int, int]:
    """Midpoints at which some shift may be a repetition, with a bound of their shifts. ``margin``: unequal items at both ends, a power of two of at least two parts."""
    n, top = len(ids), margin // 4
    mixed = ids.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    power = np.cumprod(np.full(n, _BASE, np.uint64))
    back = np.cumprod(np.full(n, _INVERSE, np.uint64))
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * power, dtype=np.uint64)))
    found: dict[int, int] = {}

    def note(mids: np.ndarray, bound: int) -> None:
        for m in mids.tolist():
            found[m] = max(found.get(m, 0), bound)

    low = 1
    while low <= top:
        width, high = max(3, low // 2), min(2 * low - 1, top)
        window = _windows(mixed, width, prefix, back)
        half = max(LEAF, low)
        while half < n:
            if half < 2 * high:
                # Nodes are rows of a table; what leaves a node to the right is looked up apart. The first node is margin.
                rows = n // (2 * half) - 2
                begin, end = 2 * half, 2 * half * (rows + 1)
                hit = np.zeros(max(rows, 0), bool)
                for table in (window[begin:end], window[begin - width : end - width]) if rows > 0 else ():
                    table = table.reshape(rows, 2 * half)
                    middle, far = table[:, half, None], min(high, half - 1)
                    for side in (table[:, half + low : half + far + 1], table[:, half - far : half - low + 1]):
                        hit |= side[:, 0] == middle[:, 0] if side.shape[1] == 1 else (side == middle).any(axis=1)
                if rows > 0 and half <= high:
                    mids = np.arange(begin + half, end, 2 * half)
                    for m in (mids, mids - width):
                        hit |= (window[m + half] == window[m]) | (window[m - half] == window[m])
                note(np.flatnonzero(hit) * 2 * half + begin + half, min(half, high))
            else:
                # The shifts are a small part of a node's row.
                mids = np.arange(half, n - margin, 2 * half)
                mids, shifts = mids[mids >= margin], np.arange(low, high + 1)
                for at in range(0, len(mids), step := max(1, (1 << 20) // len(shifts))):
                    m = mids[at : at + step, None]
                    hit = np.zeros(len(m), bool)
                    for x in (m, m - width):
                        hit |= ((window[x + shifts] == window[x]) | (window[x - shifts] == window[x])).any(axis=1)
                    note(m[hit, 0], high)
            half *= 2
        low *= 2
    return found


def _reach(ids: np.ndarray, at: int, shift: int, way: int) -> int:
    """From ``at`` on, how many items in direction ``way`` equal those ``shift`` after them."""
    total, size = 0, 16
    while True:
        a = ids[at + total : at + total + size] if way > 0 else ids[at - total - size + 1 : at - total + 1][::-1]
        b = ids[at + shift + total : at + shift + total + size] if way > 0 else ids[at + shift - total - size + 1 : at + shift - total + 1][::-1]
        same = a[: len(b)] == b
        if len(same) == size and same.all():
            total += size
            size = min(2 * size, 1 << 16)
        else:
            return total + (int(same.argmin()) if not same.all() else len(same))


def runs_of(ids: np.ndarray, longest: int, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs of a stream, sorted; longest: the most items of a part; parts end in items that occur once."""
    pad = 1 << (4 * max(longest, LEAF)).bit_length()
    margin = np.arange(pad) * -2 - (1 << 40)
    ids = np.concatenate((margin, ids, margin - 1))
    owner = np.full(len(ids), -1, np.int32)
    listed: list[tuple[int, int, int]] = []
    periods: dict[tuple[int, int], int] = {}
    known: dict[int, list[tuple[int, int]]] = {}

    def within(q: int, a: int, b: int) -> tuple[int, int] | None:
        """The known run of period q that holds [a, b)."""
        have = known.get(q, ())
        i = bisect_right(have, (a, 1 << 62)) - 1
        return have[i] if i >= 0 and have[i][1] >= b else None

    # From the top, so that long runs are known before the many small nodes in them.
    for m, r in sorted(_midpoints(ids, pad).items(), key=lambda x: -(x[0] & -x[0])):
        if owner[m] >= 0:
            # In a run of period p, repetitions of p and more words are the run's own: their period is a multiple.
            x, y, p = listed[owner[m]]
            if x <= m - 2 * r and m + 2 * r <= y and p <= r:
                r = p - 1
                if not r:
                    continue
        # ahead[r + d]: agreement of m and m + d forwards; behind[r + d]: of what stands before both, backwards.
        ahead = agreements(ids[m : m + r], ids[m - r : m + 2 * r])
        behind = agreements(ids[m - r : m][::-1], ids[m - 2 * r : m + r][::-1])[::-1]
        both = ahead + behind
        shifts = np.arange(-r, r + 1)
        here: list[tuple[int, int, int]] = []
        hits = np.flatnonzero((both >= np.abs(shifts)) & (shifts != 0))
        found = [(abs(d), m + min(d, 0) - int(behind[r + d]), m + min(d, 0) + int(ahead[r + d])) for d in (hits - r).tolist()]
        for k, a, b in sorted(found):
            # Items [a, b) equal those k after them, so [a, b + k) has period k.
            if any(k % p == 0 and x <= a and b + k <= y for p, x, y in here):
                continue
            if (whole := within(k, a, b + k)) is None:
                a -= _reach(ids, a - 1, k, -1)
                b += _reach(ids, b, k, 1)
                whole = (a, b + k)
                if whole not in known.setdefault(k, []):
                    insort(known[k], whole)
                periods[whole] = min(k, periods.get(whole, k))
                inside = owner[a : b + k]
                inside[inside < 0] = len(listed)
                listed.append((*whole, k))
            here.append((k, *whole))
    return sorted((a - pad, b - pad, p) for (a, b), p in periods.items() if b - a >= max(least, 2 * p))


class _Ids(dict):
    """Numbers of words, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def runs_of_texts(texts: list[str], least: int = LEAST) -> tuple[list[list[bytes]], list[list[tuple[int, int, int]]]]:
    """The words of each text, and its runs as (start, length, period) by start, then period."""
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    memo, stream = _Ids(), []
    for i, w in enumerate(words):
        stream.extend(map(memo.__getitem__, w))
        stream.append(-1 - i)
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    if len(stream):
        for a, b, p in runs_of(np.array(stream, np.int64), int(sizes.max()), least):
            i = int(np.searchsorted(starts, a, "right")) - 1
            out[i].append((a - int(starts[i]), b - a, p))
    return words, [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats, joined by spaces: of each run its first period stays, unless another run repeats it."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0))


def find_runs(df: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """df with n_words, runs (start, length, period: in words, by start, then period) and collapsed, the text without repeated periods.

    Columns of df with these names are replaced, whatever their case. One narrow pass; rows repeat as they are.
    """
    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]

    def function(texts: list[str]):
        words, runs = runs_of_texts(texts, least)
        flat = [r for own in runs for r in own]
        columns = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in runs]))), pa.int32())
        return [
            pa.array([len(w) for w in words], pa.int64()),
            pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, names=list(RUN.names))),
            pa.array([collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string()),
        ]

    return with_arrow(df, text_col, fields, function)
