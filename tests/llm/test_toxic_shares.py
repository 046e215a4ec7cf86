"""Toxic passages at other shares of toxic labels, and of words that are each only somewhat likelier."""

import random

import pytest

from sparkdraw.llm import toxicity


def judged(spark, share, draw):
    """(balanced accuracy on texts not learned from, the rows)"""
    rng = random.Random(11)
    rows = [(i, int(i % 20 < 20 * share)) for i in range(2400)]
    docs = spark.createDataFrame([(i, draw(rng, y)) for i, y in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, y in rows if i < 1600], "doc_id long, toxic int")
    scored = toxicity.score(docs.where("doc_id >= 1600"), toxicity.fit(docs, labels)).collect()
    right = {y: [(r.toxicity >= 0.5) == bool(y) for r in scored if rows[r.doc_id][1] == y] for y in (0, 1)}
    return sum(sum(v) / len(v) for v in right.values()) / 2, [r for r in scored if rows[r.doc_id][1]]


CLEAN, BAD = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)], [f"bad{chr(97 + i)}{chr(97 + i)}" for i in range(20)]


@pytest.mark.parametrize("share", [0.05, 0.5, 0.8])
def test_any_share_of_toxic_labels(spark, share):
    accuracy, toxic = judged(spark, share, lambda rng, y: " ".join(rng.choices(CLEAN, k=30) + (rng.choices(BAD, k=5) if y else []) + rng.choices(CLEAN, k=30)))
    assert accuracy >= 0.95
    assert sum(bool(r.passages) for r in toxic) >= 0.95 * len(toxic)


def test_words_that_are_each_a_few_times_likelier(spark):
    mild = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}mild" for i in range(60)]
    accuracy, toxic = judged(spark, 0.1, lambda rng, y: " ".join(rng.choices(CLEAN, k=40) + rng.choices(mild, k=24 if y else 4) + rng.choices(CLEAN, k=20)))
    assert accuracy >= 0.9
    assert sum(bool(r.passages) for r in toxic) >= 0.9 * len(toxic)
