"""The similarity join against brute force, and on awkward rows."""

import os
import random

import numpy as np
import pytest

from sparkdraw.llm import ngramjoin
from sparkdraw.llm.neardup import Words
from sparkdraw.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, component_id string, n_shingles string"


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def links_of(sets):
    return [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= 85 * len(a | b)]


def components(rows):
    """Sorted (doc_id, size of the set, component)."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links_of(sets):
        parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i), d) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def told(df):
    return sorted(map(tuple, df.collect()), key=repr)


def changed(rng, words, n):
    words = list(words)
    for _ in range(n if words else 0):
        i = rng.randrange(len(words))
        words[i : i + 1] = [[] if len(words) > 1 else words, [f"n{rng.randrange(500)}"], [words[i], words[i]]][rng.randrange(3)]
    return words


def families(seed, sizes=(3, 5, 9, 30, 150), members=7):
    """Groups of texts that differ by a few words, with a passage that many groups share."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(25)]
    rows = []
    for _ in range(12):
        base = [f"{rng.choice('abcdefgh')}{rng.randrange(60)}" for _ in range(rng.choice(sizes))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(members):
            base = changed(rng, base, rng.choice([0, 0, 1, 1, 2, 6])) or ["x"]
            rows.append((len(rows), rng.choice([" ", "  ", "\n"]).join(base)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_brute_force(spark, seed):
    rows = families(seed)
    assert told(ngramjoin.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))) == components(rows)


def test_one_large_group(spark):
    """Copies of one text with a few words changed each: some link with the base, some with each other only, some with nothing."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))] + [(i, " ".join(changed(rng, base, rng.choice([1, 2, 3, 4, 5, 8])))) for i in range(1, 300)]
    assert told(ngramjoin.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))) == components(rows)


def test_pairs_equal_brute_force(spark):
    rows = families(4) + [(100 + i, "one two three four five") for i in range(3)] + [(200, "ONE two  three four five"), (201, None)]
    pairs, classes = ngramjoin.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = {}
    for d, t in rows:
        sets.setdefault(shingle_set(t), []).append(d)
    assert told(classes) == sorted(((d, len(shingle_set(t)), min(sets[shingle_set(t)]) if shingle_set(t) else None) for d, t in rows), key=repr)
    own = [(min(ids), s) for s, ids in sets.items() if s]
    want = sorted((min(own[i][0], own[j][0]), max(own[i][0], own[j][0]), len(own[i][1] & own[j][1]), len(own[i][1] | own[j][1])) for i, j in links_of([s for _, s in own]))
    assert [tuple(r) for r in sorted(pairs.collect())] == want and len(want) > 20


def test_each_order_is_a_necessary_condition():
    """Sets at the threshold share a token of their prefixes under every order, however the counters stand."""
    rng = np.random.default_rng(5)
    loads = rng.integers(0, 5, (ngramjoin.ORDERS, ngramjoin.LOADS))
    for n in range(1, 120):
        both, total = next((b, t) for t in range(n, 2 * n) for b in range(t, 0, -1) if 100 * b >= 85 * t > 85 * (b - 1) or b == t)
        tokens = rng.integers(0, 1 << 63, total, np.uint64)
        cut = both + (total - both) // 2
        x, y = np.unique(tokens[:cut]), np.unique(np.concatenate((tokens[:both], tokens[cut:])))
        for k in range(ngramjoin.ORDERS):
            assert np.intersect1d(ngramjoin.prefix(x, loads, k), ngramjoin.prefix(y, loads, k)).size


def test_shingles():
    memo = Words()
    assert len(ngramjoin.shingles("a b c", memo)) == 1 and ngramjoin.shingles("A b\tC", memo).tolist() == ngramjoin.shingles("a b c", memo).tolist()
    assert len(ngramjoin.shingles("a b c d e", memo)) == 2 and not len(ngramjoin.shingles(" \n", memo))
    assert ngramjoin.shingles("É b c d", memo).tolist() != ngramjoin.shingles("é b c d", memo).tolist()


@pytest.mark.parametrize("some", [True, False])
def test_awkward_rows(spark, some):
    """Nulls, blanks, repeated rows and ids, very long texts, columns with names of results; and no rows."""
    long = " ".join(f"w{i % 977} v{i % 31}" for i in range(30_000))
    rows = [(1, "a b c d e"), (1, "a b c d e"), (1, "another text with this id"), (2, None), (3, ""), (4, " \n\t"), (5, long), (6, long + " end"), (None, "a b c d e"), (None, None), (None, "nobody has an id here"), (7, "\x1c\x85 é"), (8, "solo"), (9, "SOLO")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = ngramjoin.near_copies(df if some else df.limit(0))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert told(got) == (components(rows) if some else [])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_op11(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert told(QUERIES["op11_ngram_join"](spark, DATA)) == components(rows)
