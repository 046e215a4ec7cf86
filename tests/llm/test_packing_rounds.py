"""Packing over many partitions, and each of the three limits."""

import numpy as np
import pytest

from sparkdraw.llm import packing


def lengths_as_texts(spark, sizes, parts):
    return spark.createDataFrame([(i, "x" * (int(n) - 1)) for i, n in enumerate(sizes)], "doc_id long, text string").repartition(parts)


def tokenizer():
    """A factory of tokenizers with a token a letter; nested, so that it reaches workers by value."""

    def letters():
        import numpy

        return lambda texts: [numpy.full(len(t), 7, numpy.uint32) for t in texts]

    return letters


def used(rows, sizes, capacity):
    """Number of sequences, after a check of places and limits."""
    assert sorted(r.doc_id for r in rows) == list(range(len(sizes)))
    of = {}
    for r in rows:
        of.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in of.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity.tokens and len(spans) <= capacity.documents and sum(n * n for _, n in spans) <= capacity.attention
    return len(of)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_number_of_sequences_over_many_partitions(spark, rule):
    rng = np.random.default_rng(41)
    sizes = np.minimum(rng.geometric(1 / 250, 4000), 1024)
    bound = sizes.sum() / 1024
    capacity = packing.Capacity(rule=rule)
    for parts in (1, 40):
        rows = packing.pack(lengths_as_texts(spark, sizes, parts), tokenizer(), 2, capacity).collect()
        assert used(rows, sizes, capacity) <= 1.01 * bound + 1


@pytest.mark.parametrize(("capacity", "bound"), [
    (packing.Capacity(tokens=100), lambda s: s.sum() / 100),
    (packing.Capacity(tokens=100, documents=3, attention=10_000), lambda s: len(s) / 3),
    (packing.Capacity(tokens=100, attention=400), lambda s: (s**2).sum() / 400),
])
def test_each_limit_binds(spark, capacity, bound):
    """The limit at hand, not the other two, decides how many sequences there are."""
    sizes = np.random.default_rng(42).integers(1, 20, 1500)
    rows = packing.pack(lengths_as_texts(spark, sizes, 6), tokenizer(), 2, capacity).collect()
    least = [bound_of(sizes) for bound_of in (lambda s: s.sum() / 100, lambda s: len(s) / capacity.documents, lambda s: (s**2).sum() / capacity.attention)]
    n = used(rows, sizes, capacity)
    assert bound(sizes) == max(least) and max(least) <= n <= 1.08 * max(least) + 1


def test_sequences_set_aside_are_packed_again(spark):
    """A small window and few open sequences: nothing is lost, and what gives way is packed in the second round."""
    capacity = packing.Capacity(tokens=64, window=16, open_sequences=4)
    sizes = np.random.default_rng(43).integers(1, 64, 700)
    rows = packing.pack(lengths_as_texts(spark, sizes, 5), tokenizer(), 2, capacity).collect()
    assert used(rows, sizes, capacity) <= 1.25 * sizes.sum() / 64
