"""Prefix tries against brute force, with every split of levels between shards and merged heads."""

import hashlib
import random

import numpy as np
import pytest

from sparkdraw.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, n_convs int, turns string"


def by_dictionary(convs):
    """convs: {id: [(role, text)]}; the rows of the trie as tuples in the order of the result's columns."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for key in nodes:
        if key:
            children.setdefault(key[:-1], []).append(key)

    def below(key):
        yield key
        for child in children.get(key, ()):
            yield from below(child)

    saved = lambda key: (len(nodes[key]) - 1) * len(key[-1][1].encode().split()) if key else 0
    ends = lambda key: ",".join(map(str, sorted(c for c in nodes[key] if len(convs[c]) == len(key))))
    return sorted(
        ((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(children.get(k, ())), sum(x not in children for x in below(k)), sum(map(saved, below(k))), hashlib.sha256(ends(k).encode()).hexdigest()) for k, m in nodes.items()),
        key=repr,
    )


def told(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_louds():
    """Parents, children and totals of random tries equal those of nested dictionaries."""
    rng = random.Random(1)
    for _ in range(50):
        paths = [tuple(rng.randrange(3) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 30))]
        made = trie.Louds(np.array([p[0] for p in paths]), np.array([x for p in paths for x in p[1:]], np.int64), np.array([len(p) - 1 for p in paths]))
        names = sorted({p[:d] for p in paths for d in range(len(p) + 1)}, key=lambda p: (len(p), p))
        number = {p: i for i, p in enumerate(names)}
        assert made.levels[-1] == len(names) and len(made.bits) == 2 * len(names) - 1
        assert made.parents().tolist() == [number[p[:-1]] if p else -1 for p in names]
        assert made.children().tolist() == [sum(q[:-1] == p for q in names if q) for p in names]
        assert made.labels.tolist() == [p[-1] if p else -1 for p in names] and made.last.tolist() == [number[p] for p in paths]
        assert made.up(np.ones(len(names), np.int64)).tolist() == [sum(q[: len(p)] == p for q in names) for p in names]


@pytest.mark.parametrize(("members", "shard"), [(1, 3), (3, 1), (10, 2), (1000, 1000)])
def test_trie_equals_brute_force(spark, members, shard):
    """Copies, common first turns and conversations that end inside others."""
    rng = random.Random(members)
    convs = {}
    for c in range(-5, 60):
        convs[c] = [(rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "", "a  b"])) for _ in range(rng.randrange(6))] if c % 3 else [("user", "same words here"), ("assistant", "x")][: c % 4]
    df = spark.createDataFrame([(c, [{"role": r, "text": t} for r, t in turns]) for c, turns in convs.items()], "conv_id long, turns array<struct<role:string,text:string>>")
    assert told(trie.prefix_trie(df, members, shard)) == by_dictionary(convs)


def test_awkward_rows(spark):
    """Null turns come first and null texts are empty; ties go by role and text; rows repeat; null ids belong to nothing; other columns are left out."""
    long = "w " * 50_000
    rows = [
        (1, None, "user", "first"), (1, 2, "b", "z"), (1, 2, "a", "z"), (1, 2, "a", None), (2, 5, "user", "first"), (2, 6, "a", ""), (2, 6, "a", ""), (3, 1, None, None),
        (None, 1, "user", "nobody"), (None, None, None, None), (4, 1, "user", long), (5, 1, "user", long), (4, 2, "é", "\U0001f600"),
    ]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    convs = {1: [("user", "first"), ("a", ""), ("a", "z"), ("b", "z")], 2: [("user", "first"), ("a", ""), ("a", "")], 3: [("", "")], 4: [("user", long), ("é", "\U0001f600")], 5: [("user", long)]}
    for members in (1, 100):
        assert told(trie.prefix_trie(trie.conversations(df), members)) == by_dictionary(convs)
    none = trie.prefix_trie(trie.conversations(df.limit(0)))
    assert none.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"] and none.count() == 0
    nothing = spark.createDataFrame([(8, []), (9, None)], "conv_id long, turns array<struct<role:string,text:string>>")
    assert told(trie.prefix_trie(nothing)) == by_dictionary({8: [], 9: []})
