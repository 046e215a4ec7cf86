"""Toxic passages by maximum-scoring segments.

Learning: the distinct words of toxic and other documents are counted, whole and by their beginnings;
a chain of Dirichlet priors (base rate, beginnings from short to long, the word) gives each word a
log-odds of standing in a toxic document, of either sign. Scanning: a linear pass finds the segments of a text whose summed log-odds, less a
small cost per word, cannot be raised by lengthening or shortening. Calibration: chance scores follow
an extreme-value law whose scale solves sum p exp(lambda w) = 1 over the words of clean documents and
whose constant is fitted to their best scores; a logistic curve over that log p-value and the sum of
significant segments gives the probability. The sample is halved: the curve and the law come from
texts of one half under the words of the other, the final words from both. The same texts choose below
which size log-odds are left out, by the loss of the curve.

Null and empty texts have no words and the probability of a text without a significant segment.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, pieces, staged, with_arrow
from .labelled import SAMPLE, training_rows

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings of words that have log-odds of their own.
BEGINNINGS = (4, 5, 6)
#: Weight of the prior at each step of the chain, cost of a word, and bounds of a weight.
PRIOR, COST, MOST = 2.0, 0.02, 6.0
#: A feature needs so many words, and a log-odds that differs from the one above it in the chain by
#: so many standard deviations; weights up to the one of FLATS that suits the sample best, of either
#: sign, count as none.
SEEN, CLEAR, FLATS = 3, 3.0, (0.0, 1.0, 2.0)
#: A segment is significant if chance has one as good with less than this probability.
SIGNIFICANT = 0.01


def keys_of(word: str) -> list[str]:
    """Features of a word, from general to specific."""
    return [f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n] + [word]


def _deviance(toxic: int, seen: int, q: float) -> float:
    """Twice the log of the likelihood ratio between the share seen and q: the square of a number of standard deviations, also where a count is 0."""
    return 2 * sum(n * math.log(n / (seen * p)) for n, p in ((toxic, q), (seen - toxic, 1 - q)) if n)


def resolved(rate: float, odds: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log-odds of each feature (toxic, seen) against the rate; one that does not differ clearly from the feature above it in the chain takes that one's."""
    shares: dict[str, float] = {}
    base = math.log(rate / (1 - rate))
    # Beginnings come before the words that have them, short ones first.
    for key in sorted(odds, key=lambda k: (not k.endswith("*"), len(k))):
        above = (key[:n] + "*" for n in reversed(BEGINNINGS) if n < len(key) - 1 or (n <= len(key) and not key.endswith("*")))
        q = next((shares[k] for k in above if k in shares), rate)
        toxic, seen = odds[key]
        shares[key] = (toxic + PRIOR * q) / (seen + PRIOR) if _deviance(toxic, seen, q) > CLEAR**2 else q
    return {k: max(-MOST, min(math.log(q / (1 - q)) - base, MOST)) for k, q in shares.items()}


@dataclass
class ToxicModel:
    rate: float = 0.5
    odds: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0
    constant: float = 1.0
    curve: tuple[float, ...] = (-3.0, 0.0, 0.0)
    flat: float = 0.0

    def weight(self, word: str) -> float:
        """The log-odds of the word, else of its longest known beginning."""
        w = self.odds.get(word)
        if w is None:
            w = next((v for n in reversed(BEGINNINGS) if len(word) >= n and (v := self.odds.get(word[:n] + "*")) is not None), 0.0)
        return w if abs(w) > self.flat else 0.0

    def log_p(self, score: float, words: int) -> float:
        """Log of the probability that chance alone scores as high in so many words."""
        if score <= 0 or not words:
            return 0.0
        e = math.log(self.constant * words) - self.scale * score
        return e if e < -20 else math.log(-math.expm1(-math.exp(min(e, 30))))

    def probability(self, log_p: float, total: float) -> float:
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * math.log1p(-log_p) + c * math.log1p(total)))))


class Memo(dict):
    """Weights of words met so far by one task, MOST_WORDS at most."""

    MOST_WORDS = 400_000

    def __init__(self, model: ToxicModel):
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= self.MOST_WORDS:
            self.clear()
        self[word] = w = self.model.weight(word)
        return w


def weights_of(text: str, memo: Memo) -> np.ndarray:
    words = WORD.findall(text.lower())
    return np.fromiter(map(memo.__getitem__, words), float, len(words))


def segments(weights: np.ndarray, cost: float = COST) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, end, score), in order, in time linear in the words.

    Words of no or negative weight only cost, so the scan visits the others. Each candidate keeps the sum before
    it, the sum after it, and the nearest earlier candidate that starts lower: a search goes from one
    of those to the next and passes over all between. A candidate joins with one found so if that ends lower.
    """
    at = np.flatnonzero(weights > cost)
    if not len(at):
        return []
    sums = np.cumsum(weights - cost)
    firsts: list[int] = []
    ends: list[int] = []
    befores: list[float] = []
    afters: list[float] = []
    lower: list[int] = []
    for i, after, before in zip(at.tolist(), sums[at].tolist(), (sums[at] - (weights[at] - cost)).tolist(), strict=True):
        first, j = i, len(firsts) - 1
        while True:
            while j >= 0 and befores[j] >= before:
                j = lower[j]
            if j < 0 or afters[j] >= after:
                break
            first, before, near = firsts[j], befores[j], lower[j]
            for column in (firsts, ends, befores, afters, lower):
                del column[j:]
            j = near
        firsts.append(first)
        ends.append(i + 1)
        befores.append(before)
        afters.append(after)
        lower.append(j)
    return [(a, b, after - before) for a, b, before, after in zip(firsts, ends, befores, afters, strict=True)]


def best_score(weights: np.ndarray, cost: float = COST) -> float:
    """Score of the best segment, 0 if there is none."""
    if not len(weights):
        return 0.0
    sums = np.concatenate(([0.0], np.cumsum(weights - cost)))
    return float((sums - np.minimum.accumulate(sums)).max())


def evidence(text: str, model: ToxicModel, memo: Memo) -> tuple[float, float, list[tuple[int, int, float]], np.ndarray]:
    """Best log p-value, sum of significant scores, significant segments, all weights."""
    weights = weights_of(text, memo)
    log_p = model.log_p(best_score(weights), len(weights))
    found = [s for s in segments(weights) if model.log_p(s[2], len(weights)) < math.log(SIGNIFICANT)] if log_p < math.log(SIGNIFICANT) else []
    return log_p, sum(s[2] for s in found), found, weights


def _count(rows: DataFrame) -> DataFrame:
    """(feature, toxic0, seen0, toxic1, seen1): distinct words with the feature, summed over the documents of each half; all words have ""."""
    names = ["toxic0", "seen0", "toxic1", "seen1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                counts = [Counter() for _ in names]
                for text, label, half in zip(*[part.column(c).to_pylist() for c in ("text", "label", "half")], strict=True):
                    keys = Counter(k for w in set(WORD.findall(text.lower())) for k in ("", *keys_of(w)))
                    counts[2 * half + 1].update(keys)
                    if label:
                        counts[2 * half].update(keys)
                have = list(counts[1] | counts[3])
                yield pa.RecordBatch.from_arrays([pa.array(have, pa.string()), *[pa.array([c[k] for k in have], pa.int64()) for c in counts]], names=["feature", *names])

    found = rows.mapInArrow(run, "feature string, " + ", ".join(f"{c} long" for c in names))
    return found.groupBy("feature").agg(*[F.sum(c).alias(c) for c in names])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method; the first column of x is 1."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> ToxicModel:
    """Learn from at most ``sample`` labelled rows; the driver gets counts of features, and for each cut two numbers a row."""
    half = (F.crc32(F.concat(F.lit("half "), F.col("doc_id").cast("string")).cast("binary")) % 2).cast("int")
    rows = staged(training_rows(docs, labels, label, sample).withColumn("half", half), "sample")
    counts = staged(_count(rows), "features")
    try:
        return _fit(rows, counts)
    finally:
        discard(rows, counts)


def _fit(rows: DataFrame, counts: DataFrame) -> ToxicModel:
    model = ToxicModel()
    sizes = {r["half"]: (r["n"], r["p"]) for r in rows.groupBy("half").agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect()}
    n, positive = (sum(x[i] for x in sizes.values()) for i in (0, 1))
    if not n or not positive or positive == n:
        return model
    total = counts.where("feature = ''").first()
    if total is None or not 0 < total["toxic0"] + total["toxic1"] < total["seen0"] + total["seen1"]:
        return model
    model.rate = (total["toxic0"] + total["toxic1"]) / (total["seen0"] + total["seen1"])
    every: dict[str, tuple[int, int]] = {}
    half: list[dict[str, tuple[int, int]]] = [{}, {}]
    for r in counts.where((F.col("feature") != "") & (F.col("seen0") + F.col("seen1") >= SEEN)).toLocalIterator():
        every[r["feature"]] = (r["toxic0"] + r["toxic1"], r["seen0"] + r["seen1"])
        for h in (0, 1):
            if r[f"seen{h}"] >= SEEN:
                half[h][r["feature"]] = (r[f"toxic{h}"], r[f"seen{h}"])
    model.odds = resolved(model.rate, every)
    # Rows of one half are judged by the words of the other.
    other = [ToxicModel(model.rate, resolved(model.rate, half[1 - h])) for h in (0, 1)]
    measured = _measured(rows, other)
    try:
        return _calibrated(model, measured)
    finally:
        discard(measured)


def _calibrated(model: ToxicModel, measured: DataFrame) -> ToxicModel:
    """The cut, law and curve with the least loss. The driver gets best scores, sums of significant scores and word counts by rounded weight; a text's segments stay where they are."""
    found = sorted(measured.select("id", "label", "words", "best").collect(), key=lambda r: r["id"])
    clean = [r for r in found if not r["label"]]
    if not clean or len(clean) == len(found):
        return model
    counts: list[dict[float, int]] = [{} for _ in FLATS]
    heavy = measured.select(F.posexplode(F.arrays_zip("heavy", "times")).alias("k", "both")).select("k", F.explode(F.arrays_zip("both.heavy", "both.times")).alias("v"))
    for r in heavy.groupBy("k", F.col("v.heavy").alias("weight")).agg(F.sum("v.times").alias("n")).collect():
        counts[r["k"]][r["weight"]] = r["n"]
    tried = [ToxicModel(model.rate, model.odds, flat=flat) for flat in FLATS]
    for k, one in enumerate(tried):
        _extremes(one, counts[k], [(r["words"], r["best"][k]) for r in clean])
    sums = measured.select("id", *[_significant(one, k).alias(f"s{k}") for k, one in enumerate(tried)])
    totals = {r["id"]: r[1:] for r in sums.collect()}

    best, chosen = math.inf, model
    y = np.array([r["label"] for r in found], float)
    for k, one in enumerate(tried):
        x = np.array([(1.0, math.log1p(-one.log_p(r["best"][k], r["words"])), math.log1p(totals[r["id"]][k])) for r in found])
        curve = _logistic(x, y)
        one.curve = tuple(curve.tolist())
        loss = float(np.logaddexp(0, np.where(y > 0, -1, 1) * np.clip(x @ curve, -30, 30)).mean())
        if loss < best:
            best, chosen = loss, one
    return chosen


def _significant(model: ToxicModel, k: int) -> F.Column:
    """Sum of the scores that are significant by ``log_p``, which falls as the score grows."""
    least = (F.log(F.lit(model.constant) * F.col("words")) - math.log(-math.log1p(-SIGNIFICANT))) / model.scale
    return F.aggregate(F.filter(F.get("scores", F.lit(k)), lambda s: (s > 0) & (s > least)), F.lit(0.0), lambda a, s: a + s)


def _measured(rows: DataFrame, other: list[ToxicModel]) -> DataFrame:
    """A table of each row's scores under the words of the other half, for each of FLATS; clean rows' weights are counted by batch, in one of its rows."""
    models = rows.sparkSession.sparkContext.broadcast([[ToxicModel(m.rate, m.odds, flat=flat) for m in other] for flat in FLATS])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [[Memo(m) for m in pair] for pair in models.value]
        for batch in batches:
            for part in pieces(batch, "text"):
                out, heavy = [], [Counter() for _ in FLATS]
                for doc_id, text, y, h in zip(*[part.column(c).to_pylist() for c in ("doc_id", "text", "label", "half")], strict=True):
                    words = WORD.findall(text.lower())
                    best, scores = [], []
                    for k in range(len(FLATS)):
                        w = np.fromiter(map(memos[k][h].__getitem__, words), float, len(words))
                        if not y:
                            heavy[k].update(np.round(w[w != 0], 1).tolist())
                        best.append(best_score(w))
                        scores.append([s[2] for s in segments(w)])
                    out.append([str(doc_id), best, len(words), y, [[]] * len(FLATS), [[]] * len(FLATS), scores])
                if out:
                    out[-1][4:6] = [list(c) for c in heavy], [list(c.values()) for c in heavy]
                cols = list(zip(*out, strict=True)) or [[]] * 7
                many = pa.list_(pa.list_(pa.float64()))
                kinds = [pa.string(), pa.list_(pa.float64()), pa.int64(), pa.int32(), many, pa.list_(pa.list_(pa.int64())), many]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "best", "words", "label", "heavy", "times", "scores"])

    schema = "id string, best array<double>, words long, label int, heavy array<array<double>>, times array<array<long>>, scores array<array<double>>"
    found = staged(rows.mapInArrow(measure, schema), "measured")
    models.unpersist()
    return found


def _extremes(model: ToxicModel, counts: dict[float, int], clean: list[tuple[int, float]]) -> None:
    """Scale from the law of the weights (how often each occurs in clean documents), constant from the best scores of clean documents: (words, best)."""
    words = sum(n for n, _ in clean)
    if not words or not counts:
        return
    w = np.array(sorted(counts), float)
    p = np.array([counts[v] for v in sorted(counts)], float) / words
    rest = 1 - p.sum()
    excess = lambda t: rest * math.exp(-t * COST) + float((p * np.exp(t * (w - COST))).sum()) - 1
    low, high = 1e-4, 20.0
    if excess(low) >= 0:
        low = high = 0.05  # the mean weight isn't negative: no law holds, so few scores count
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    model.scale = max(low, 0.05)
    # The mean of exp(-scale * best) over texts of n words is near 1 / (1 + constant * n).
    chance = np.mean([math.exp(-model.scale * top) for _, top in clean])
    model.constant = max(1e-6, (1 / max(chance, 1e-9) - 1) * len(clean) / words)


PASSAGE = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("log_p", T.DoubleType())]))


def score(df: DataFrame, model: ToxicModel, text_col: str = "text", out_col: str = "toxicity", passages_col: str = "passages") -> DataFrame:
    """df with toxicity (0 to 1) and passages (code points, end exclusive, score, log p-value); columns of those names are replaced."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("log_p", pa.float64())]))

    shared = df.sparkSession.sparkContext.broadcast(model)
    held: list[Memo] = []  # a task's own, kept from one piece to the next

    def run(texts: list[str]):
        model = shared.value
        if not held:
            held.append(Memo(model))
        memo, scores, passages = held[0], [], []
        for text in texts:
            log_p, total, found, weights = evidence(text, model, memo)
            scores.append(model.probability(log_p, total))
            if found:
                # Lower-casing can change a text's length, so places come from the original.
                at = [m.span() for m in WORD.finditer(text)]
                whole = len(at) == len(weights)
                found = [{"start": at[a][0] if whole else 0, "end": at[b - 1][1] if whole else len(text), "score": s, "log_p": model.log_p(s, len(weights))} for a, b, s in found]
            passages.append(found)
        yield pa.array(scores, pa.float64())
        yield pa.array(passages, kind)

    return with_arrow(df, text_col, [T.StructField(out_col, T.DoubleType()), T.StructField(passages_col, PASSAGE)], run)
