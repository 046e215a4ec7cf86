"""Quality by a generalised additive model with pairwise interactions.

Each feature of a text falls into one of a few bins. Cyclic boosting visits the features in turn and
fits a shallow tree over the bins to what is left of the loss; the trees of a feature add up to one
lookup table. Pairs of features that explain most of the remainder get tables in the same way. A
score is the sum of a text's table entries, taken for whole batches at once.

Null texts count as empty; empty texts have features of 0 and a score like any other.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import pieces, with_arrow
from .labelled import SAMPLE, training_rows

FEATURES = (
    "log_bytes", "log_words", "word_length", "longest_word", "letters", "digits", "punctuation", "symbols", "upper", "high_bytes", "spaces",
    "exclaims", "bars", "commas_stops", "log_lines", "words_a_line", "repeated_lines", "distinct_words", "top_word", "twice_running",
    "distinct_pairs", "packed", "symbol_words", "upper_words", "short_words", "at_signs",
)
BINS, ROUNDS, RATE, LEAVES, SMOOTH = 32, 150, 0.12, 4, 5.0
PAIRS, PAIR_BINS, PAIR_ROUNDS = 8, 8, 80

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER | np.roll(_UPPER, 32)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_HIGH = np.arange(256) >= 128
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SYMBOL = np.isin(np.arange(256), list(b"#$%&*@^~|<>{}[]\\_=+"))
_PUNCT = ~(_LETTER | _DIGIT | _HIGH | _SPACE) & (np.arange(256) > 32)


def features(text: str) -> list[float]:
    """The features of one text, in the order of FEATURES."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(FEATURES)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    words = raw.split()
    m = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    pairs = len(set(zip(words, words[1:])))  # noqa: B905
    running = sum(a == b for a, b in zip(words, words[1:]))  # noqa: B905
    marked = sum(t for w, t in seen.items() if _SYMBOL[w[-1]] and len(w) > 1)
    shout = sum(t for w, t in seen.items() if len(w) > 1 and w.isupper())
    part = lambda mask: float(c[mask].sum()) / n
    return [
        np.log1p(n), np.log1p(len(words)), float(lengths.sum()) / m, np.log1p(float(lengths.max(initial=0))), part(_LETTER), part(_DIGIT), part(_PUNCT), part(_SYMBOL),
        part(_UPPER), part(_HIGH), part(_SPACE), c[33] / n, c[124] / n, (c[44] + c[46]) / n, np.log1p(len(lines)), len(words) / k,
        1 - len(set(lines)) / k, len(seen) / m, max(seen.values(), default=0) / m, running / m, pairs / m, len(zlib.compress(raw, 1)) / n,
        marked / m, shout / m, float((lengths <= 2).sum()) / m, c[64] / n,
    ]


@dataclass
class AdditiveModel:
    """Bin edges, one table a feature, and pairs with their edges and tables."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (edge, tab) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += tab[np.searchsorted(edge, x[:, j], "right")]
        for i, j, ei, ej, tab in self.pairs:
            out += tab[np.searchsorted(ei, x[:, i], "right"), np.searchsorted(ej, x[:, j], "right")]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf values over bins: the best cut is added until there are ``leaves`` leaves."""
    spans = [(0, len(g))]
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + SMOOTH)
    while len(spans) < leaves:
        best = (1e-9, None, 0)
        for s in spans:
            a, b = s
            if b - a < 2:
                continue
            cuts = np.arange(a + 1, b)
            gain = worth(a, cuts) + worth(cuts, b) - worth(a, b)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), s, int(cuts[i]))
        if best[1] is None:
            break
        spans.remove(best[1])
        spans += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + SMOOTH)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of each axis of a grid together, and the values of its four parts."""
    cg, ch = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, h))

    def worth(c, d):
        return c**2 / (d + SMOOTH)

    a, b = cg[1:-1, 1:-1], ch[1:-1, 1:-1]
    right, rh = cg[1:-1, -1:] - a, ch[1:-1, -1:] - b
    down, dh = cg[-1:, 1:-1] - a, ch[-1:, 1:-1] - b
    rest, sh = cg[-1, -1] - a - right - down, ch[-1, -1] - b - rh - dh
    gain = worth(a, b) + worth(right, rh) + worth(down, dh) + worth(rest, sh) - worth(cg[-1, -1], ch[-1, -1])
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    out[: i + 1, : j + 1] = a[i, j] / (b[i, j] + SMOOTH)
    out[: i + 1, j + 1 :] = right[i, j] / (rh[i, j] + SMOOTH)
    out[i + 1 :, : j + 1] = down[i, j] / (dh[i, j] + SMOOTH)
    out[i + 1 :, j + 1 :] = rest[i, j] / (sh[i, j] + SMOOTH)
    return float(gain[i, j]), out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> AdditiveModel:
    """Learn from features x (rows, columns) and labels y of 0 and 1."""
    rate = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    start = float(np.log(rate / (1 - rate)))
    width = x.shape[1]
    if len(y) < 2 or y.min() == y.max():
        return AdditiveModel(start, [np.zeros(0)] * width, [np.zeros(1)] * width, [])
    edges = [_edges(x[:, j], BINS) for j in range(width)]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    f = np.full(len(y), start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(width):
            g, h = slopes()
            n = len(tables[j])
            step = RATE * _tree(np.bincount(bins[j], g, n), np.bincount(bins[j], h, n), LEAVES)
            tables[j] += step
            f += step[bins[j]]
    coarse = [_edges(x[:, j], PAIR_BINS) for j in range(width)]
    cells = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]

    def grid(i: int, j: int) -> tuple[float, np.ndarray]:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        at = cells[i] * shape[1] + cells[j]
        return _quadrants(np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape))

    g, h = slopes()
    ranked = sorted(((grid(i, j)[0], i, j) for i in range(width) for j in range(i)), reverse=True)[:pairs]
    made = {(i, j): np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for _, i, j in ranked}
    for _ in range(PAIR_ROUNDS):
        for (i, j), tab in made.items():
            g, h = slopes()
            step = RATE * grid(i, j)[1]
            tab += step
            f += step[cells[i], cells[j]]
    return AdditiveModel(start, edges, tables, [(i, j, coarse[i], coarse[j], tab) for (i, j), tab in made.items()])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> AdditiveModel:
    """Learn from at most ``sample`` labelled rows; the driver gets their features, not their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                x = [features(t) for t in part.column("text").to_pylist()]
                ids = [str(i) for i in part.column("doc_id").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), part.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["id", "label", "x"])

    rows = training_rows(docs, labels, label, sample).mapInArrow(run, "id string, label int, x array<double>").collect()
    rows.sort(key=lambda r: (r["id"], r["label"]))
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return boost(x, np.array([r["label"] for r in rows], float))


def score(df: DataFrame, model: AdditiveModel, text_col: str = "text", out_col: str = "quality") -> DataFrame:
    """df with quality (0 to 1) in ``out_col``; a column of that name is replaced."""

    def run(texts: list[str]):
        x = np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))
        yield pa.array(model.predict(x), pa.float64())

    return with_arrow(df, text_col, [T.StructField(out_col, T.DoubleType())], run)
