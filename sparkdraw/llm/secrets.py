"""Secret scans: fixed patterns, and a battery of randomness tests over unlabelled strings.

A candidate is a long run of encoding characters. Its encoding is inferred from the characters it
has. The battery tests it for chi-squared uniformity over that alphabet, for runs above and below the
middle, and for serial correlation; together (Bonferroni) they must fit a uniform source. What remains
is weighed against written language: each test statistic has a p-value under models of ordinary
strings, made an e-value by a calibrator, and the likelihood ratio of a uniform source, averaged over
all encodings as the encoding was chosen after looking, is another; their mean is the candidate's
e-value. The e-BH procedure with weights by length controls the share of false findings in each
document.

Time is linear in the text, however many spans it has. Null texts count as empty. Spans are code
points, end exclusive, by start, then kind as in KINDS.
"""

from __future__ import annotations

import math
import operator
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_arrow

KINDS = ("assign", "access", "hex", "random")
#: Least length of a candidate of the battery, level of each test, and false-discovery rate.
LEAST, LEVEL, RATE = 20, 0.001, 0.01

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}")

_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Name and alphabet of each encoding, the narrowest first.
ENCODINGS = [
    ("decimal", _DIGIT), ("hex", _DIGIT + "abcdef"), ("HEX", _DIGIT + "ABCDEF"), ("base32", _UPPER + "234567"), ("base36", _DIGIT + _LOWER),
    ("BASE36", _DIGIT + _UPPER), ("base62", _UPPER + _LOWER + _DIGIT), ("base64", _UPPER + _LOWER + _DIGIT + "+/"), ("base64url", _UPPER + _LOWER + _DIGIT + "-_"),
]
#: Letters from the most to the least common in European text; their shares follow a geometric rule.
_ORDER = "etainosrhldcumfpgwybvkxjqz"
_SHARE = {c: 0.91**i for i, c in enumerate(_ORDER)}
_SUM = sum(_SHARE.values())


def _models() -> list[dict[str, float]]:
    """Log-probabilities of characters in lower-case words, in upper-case words and in numbers."""
    rest = math.log(0.02 / 4)
    out = []
    for letters, other, digits in ((0.9, 0.03, 0.05), (0.03, 0.9, 0.05), (0.05, 0.05, 0.88)):
        one = dict.fromkeys("+/-_", rest) | dict.fromkeys(_DIGIT, math.log(digits / 10))
        one |= {c: math.log(letters * s / _SUM) for c, s in _SHARE.items()}
        one |= {c.upper(): math.log(other * s / _SUM) for c, s in _SHARE.items()}
        out.append(one)
    return out


MODELS = _models()


def encoding(body: str) -> tuple[str, str] | None:
    """The narrowest encoding that has all characters of body."""
    have = set(body)
    return next(((name, letters) for name, letters in ENCODINGS if have <= set(letters)), None)


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _log_lower_tail(z: float) -> float:
    """Log of the normal distribution function."""
    if z > -30:
        return math.log(0.5 * math.erfc(-z / math.sqrt(2)))
    return -z * z / 2 - math.log(-z * math.sqrt(2 * math.pi))


class Source:
    """How ordinary strings of one model spread over an alphabet: sums of squares and cubes of the shares, share of the upper half."""

    def __init__(self, model: dict[str, float], alphabet: str):
        shares = np.exp([model[c] for c in alphabet])
        shares /= shares.sum()
        self.squares, self.cubes, self.high = float((shares**2).sum()), float((shares**3).sum()), float(shares[(len(alphabet) + 1) // 2 :].sum())


_PLACES = {name: {c: i for i, c in enumerate(letters)} for name, letters in ENCODINGS}
_SOURCES = {name: [Source(m, letters) for m in MODELS] for name, letters in ENCODINGS}


def battery(body: str, name: str) -> tuple[tuple[float, float, float], tuple[float, float]]:
    """p-values of chi-squared uniformity, of runs about the middle and of serial correlation over encoding ``name``; log e-values of the first two against ordinary strings.

    Chi-squared is a count of equal pairs of characters: n and the alphabet fix the rest. Ordinary
    strings have more equal pairs than random ones, and fewer or more runs; the serial correlation of
    independent ordinary letters is that of random ones, so it tells nothing against them.
    """
    places = _PLACES[name]
    k, n = len(places), len(body)
    x = list(map(places.__getitem__, body))
    counts = [0] * k
    for i in x:
        counts[i] += 1
    equal = sum(c * (c - 1) for c in counts) / 2
    chi = k * (n + 2 * equal) / n - n
    df = k - 1
    z = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    uniform = 0.5 * math.erfc(z / math.sqrt(2))
    middle = (k + 1) // 2
    above = [i >= middle for i in x]
    a = sum(above)
    b = n - a
    turns = 1 + sum(map(operator.ne, above, above[1:]))
    if a and b:
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = _normal_tail((turns - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        runs = 2.0 ** (1 - n)
    level = sum(x) / n
    spread = [i - level for i in x]
    power = sum(map(operator.mul, spread, spread))
    serial = _normal_tail((sum(map(operator.mul, spread, spread[1:])) / power + 1 / n) * math.sqrt(n)) if power else 0.0
    by_pairs = by_runs = math.inf
    for s in _SOURCES[name]:
        pairs = n * (n - 1) / 2
        var = pairs * (s.squares - s.squares**2) + n * (n - 1) * (n - 2) * (s.cubes - s.squares**2)
        by_pairs = min(by_pairs, _calibrated(_log_lower_tail((equal - pairs * s.squares) / math.sqrt(max(var, 1e-9)))))
        change = 2 * s.high * (1 - s.high)
        var = max((n - 1) * change * (1 - change) + (n - 2) * (change - 2 * change**2), (n - 1) * 1e-3)
        by_runs = min(by_runs, _calibrated(min(0.0, math.log(2) + _log_lower_tail(-abs(turns - 1 - (n - 1) * change) / math.sqrt(var)))))
    return (uniform, runs, serial), (by_pairs, by_runs)


def _calibrated(log_p: float) -> float:
    """Log of the e-value 1 / (2 sqrt(p))."""
    return -log_p / 2 - math.log(2)


def log_evidence(body: str, alphabet: str) -> float:
    """Log of the likelihood ratio of a uniform source to the best model of ordinary strings; the alphabet is one of all ENCODINGS."""
    return -math.log(len(ENCODINGS)) - len(body) * math.log(len(alphabet)) - max(sum(map(m.__getitem__, body)) for m in MODELS)


def log_e_value(body: str) -> float | None:
    """Log e-value of a body against ordinary strings; minus infinity if the battery rejects a uniform source; None without an encoding."""
    if (enc := encoding(body)) is None:
        return None
    ratio = log_evidence(body, enc[1])
    if ratio <= -math.log(len(ENCODINGS)):
        return -math.inf
    tests, against = battery(body, enc[0])
    if min(tests) * len(tests) < LEVEL:
        return -math.inf
    parts = (ratio, *against, 0.0)  # serial correlation gives 1
    top = max(parts)
    return top + math.log(sum(math.exp(p - top) for p in parts) / len(parts))


def chosen(found: list[tuple[float, int]], rate: float = RATE) -> list[bool]:
    """e-BH over (log e-value, length) with weights in proportion to the length."""
    if not found:
        return []
    mean = sum(n for _, n in found) / len(found)
    weighed = [e + math.log(n / mean) for e, n in found]
    ranked = sorted(weighed, reverse=True)
    k = max((i for i, e in enumerate(ranked, 1) if e >= math.log(len(ranked) / (rate * i))), default=0)
    return [k > 0 and e >= ranked[k - 1] for e in weighed]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, unsorted."""
    out = []
    folded = text.encode("utf-8", "surrogatepass").lower()
    if any(k in folded for k in (b"passw", b"secret", b"token", b"api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in folded.translate(_HEX_CLASS):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


_HEX_CLASS = bytes(ord("h") if chr(i) in _DIGIT + "abcdef" else 32 for i in range(256))
_RUN_CLASS = bytes(ord("x") if chr(i) in _DIGIT + _LOWER + "+/_-" else 32 for i in range(256))


def random_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strings that the battery adds; those that touch a taken span are left out."""
    folded = text.encode("utf-8", "surrogatepass").lower().translate(_RUN_CLASS)
    if b"x" * LEAST not in folded:
        return []
    taken = sorted((a, b) for a, _, b in taken)
    spans, evidence = [], []
    known: dict[str, float | None] = {}
    j = reach = 0  # taken spans before j start before the candidate's end; the farthest of them ends at reach
    for m in RUN.finditer(text):
        while j < len(taken) and taken[j][0] < m.end():
            reach = max(reach, taken[j][1])
            j += 1
        if reach > m.start():
            continue
        body = m[0].rstrip("=")
        if body not in known:
            known[body] = log_e_value(body)
        if known[body] is None:
            continue
        spans.append((m.start(), 3, m.end()))
        evidence.append((known[body], len(body)))
    return [s for s, yes in zip(spans, chosen(evidence), strict=True) if yes]


def spans_of(text: str) -> list[dict]:
    base = base_spans(text)
    return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(base + random_spans(text, base))]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_secrets(df: DataFrame, text_col: str = "text", out_col: str = "secret_spans") -> DataFrame:
    """df with an array of (kind, start, end) for each text."""
    return with_arrow(df, text_col, [T.StructField(out_col, SPANS)], lambda texts: [pa.array([spans_of(t) for t in texts], _SPANS)])


def redacted(text: str) -> str:
    """text with each found stretch replaced by <secret>; stretches that overlap go as one."""
    out, at = [], 0
    for s in spans_of(text):
        if s["start"] >= at:
            out += [text[at : s["start"]], "<secret>"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def redact_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the secrets in its texts replaced; null texts stay null, columns and their order stay."""
    made = with_arrow(df, text_col, [T.StructField("redacted__", T.StringType())], lambda texts: [pa.array([redacted(t) for t in texts], pa.string())])
    return made.select(*[F.when(F.col(text_col).isNotNull(), F.col("redacted__")).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])
