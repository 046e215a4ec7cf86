"""Periodic runs against brute force, and on awkward rows."""

import hashlib
import os
import random
import zlib

import pytest

from sparkdraw.llm import runs
from sparkdraw.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def by_shifts(words, least=12):
    """Every run, by walking along each shift."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= max(q, least - q):
                best[i, j + q] = min(q, best.get((i, j + q), q))
            i = j + 1
    return sorted(((a, b - a, q) for (a, b), q in best.items() if b - a >= max(least, 2 * q)), key=lambda r: (r[0], r[2]))


def without_repeats(words, found):
    return " ".join(w for i, w in enumerate(words) if not any(a + q <= i < a + n for a, n, q in found))


def test_z_function():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randrange(1, 30))]
        assert runs.z_function(s)[1:] == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(1, len(s))]


@pytest.mark.parametrize("small", [0, 8, runs.SMALL])
def test_runs_equal_brute_force(monkeypatch, small):
    """Batches of texts with few and many different words, planted periods, and periods within periods."""
    monkeypatch.setattr(runs, "SMALL", small)
    rng = random.Random(2)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 10)):
            kinds = [f"w{i}" for i in range(rng.choice([1, 2, 3, 5, 60]))]
            words = rng.choices(kinds, k=rng.randrange(90))
            for _ in range(rng.randrange(3)):
                if words:
                    piece = words[rng.randrange(len(words)) :][: rng.randrange(1, 25)]
                    at = rng.randrange(len(words))
                    words = words[:at] + piece * rng.randrange(2, 7) + words[at:]
            texts.append(" ".join(words))
        found = runs.runs_of_texts(texts)
        for t, words, own in zip(texts, *found, strict=True):
            assert own == by_shifts(t.split())
            assert runs.collapsed(words, own).decode() == without_repeats(t.split(), own)


def test_long_runs_take_little_time():
    words = ["a", "b"] * 30_000
    for text, want in ((words, (0, 60_000, 2)), (["x"] * 50_000, (0, 50_000, 1)), ([f"w{i % 20_000}" for i in range(50_000)], (0, 50_000, 20_000))):
        assert runs.runs_of_texts([" ".join(text)])[1] == [[want]]


def test_awkward_rows(spark):
    """Null, empty and blank texts have no words; rows repeat; columns with names of results are replaced."""
    line = " ".join(["one two three"] * 4)
    rows = [(1, line, "x"), (1, line, "x"), (2, None, None), (3, "", "y"), (None, " \n\t", "z"), (4, "é é " * 12, "x"), (5, "w " * 70_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, RUNS string")
    got = runs.find_runs(df)
    assert got.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    told = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect())
    assert told == [(0, 0, [], ""), (1, 12, [(0, 12, 3)], "one two three"), (1, 12, [(0, 12, 3)], "one two three"), (2, 0, [], ""), (3, 0, [], ""), (4, 12, [(0, 12, 1)], "é é"), (5, 70_000, [(0, 70_000, 1)], "w")]
    assert runs.find_runs(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_op13(spark):
    """The registered query against brute force over the same table."""
    got = {r.doc_id: r for r in QUERIES["op13_runs"](spark, DATA).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert set(got) == set(texts)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    planted = 0
    for d, t in texts.items():
        words = [w.decode() for w in (t or "").encode().split()]
        n, h = len(words), zlib.crc32(str(d).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            planted += 1
        found = by_shifts(words) if n <= 4000 else None
        if found is None:
            continue
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want = (len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2], digest("".join(f"{a},{k},{q}\n" for a, k, q in found)), digest(without_repeats(words, found)))
        r = got[d]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == want
    assert planted > 5
