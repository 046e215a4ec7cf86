"""The similarity join's sketches: no linked pair is put aside, and sets are built for near pairs alone."""

import random

import numpy as np
import pytest
from test_ngramjoin import components, told

from sparkdraw.llm import ngramjoin


def words_of(sketch):
    return np.frombuffer(sketch, np.uint64)


def test_sketches_tell_no_more_than_sets():
    """Hashes told to be unshared are at most those that are, whatever the sizes; for sets far apart enough are told."""
    rng = np.random.default_rng(3)
    for n in [*range(1, 140), 500, 1023, 1024, 1025, 3000]:
        for own in (0, 1, n // 12, n):
            tokens = rng.integers(0, 1 << 63, n + 2 * own, np.uint64)
            x, y = np.unique(tokens[: n + own]), np.unique(np.concatenate((tokens[:n], tokens[n + own :], tokens[:1])))
            told_ = ngramjoin.unshared(words_of(ngramjoin.sketch(x)), words_of(ngramjoin.sketch(y)))
            assert told_ == ngramjoin.unshared(words_of(ngramjoin.sketch(y)), words_of(ngramjoin.sketch(x)))
            assert told_ <= len(np.setxor1d(x, y)) and (own or not told_)
            if n >= 500 and own == n:
                assert told_ * (100 + ngramjoin.SHARE) > (len(x) + len(y)) * (100 - ngramjoin.SHARE)
    small, large = (ngramjoin.sketch(rng.integers(0, 1 << 63, n, np.uint64)) for n in (1, 5000))
    assert len(small) == 8 and len(large) == 1024
    assert ngramjoin.unshared(words_of(small), words_of(large)) <= 5001


def test_sets_of_near_pairs_alone(spark, monkeypatch):
    """Texts of a family meet in their prefixes but fall short of the threshold; before, sets were built for them all."""
    rng = random.Random(11)
    rows = []
    for f in range(6):
        base = [f"f{f}w{i}" for i in range(300)]
        for _ in range(25):
            words = list(base)
            # Twenty shingles of its own: few enough for a prefix to reach shared ones, but about 0.76 with others.
            for i in rng.sample(range(0, 300, 4), 5):
                words[i] = f"n{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), rows[-1][1] + " end"))
    asked, sets_of = [], ngramjoin._Join.sets_of

    def counted(self, nodes):
        asked.append(nodes.count())
        return sets_of(self, nodes)

    monkeypatch.setattr(ngramjoin._Join, "sets_of", counted)
    assert told(ngramjoin.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))) == components(rows)
    assert 12 <= sum(asked) <= 40


@pytest.mark.parametrize("n", [13, 17, 33, 64, 65, 129, 400])
def test_pairs_at_the_threshold(spark, n):
    """Links of just the share, between sets of different sizes too, where one has twice the other's slots."""
    rows = []
    for k in range(12):
        own = [f"k{k}w{i}" for i in range(n + 3)]
        most = n * 100 // ngramjoin.SHARE - n
        rows += [(len(rows) + i, " ".join(own + [f"k{k}x{j}" for j in range(more)])) for i, more in enumerate((0, most, most + 1))]
    pairs, _ = ngramjoin.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.a, r.b) for r in pairs.collect()}
    want = {(d, d + 1) for d in range(0, len(rows), 3)} | {(d + 1, d + 2) for d in range(0, len(rows), 3)}
    assert want == got
