"""All maximal segments against their definition, and the time of the scan; one training row an id."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdraw.llm import labelled, toxicity


def by_definition(x, a, b):
    """The best segment, then those left and right of it."""
    best = max(((sum(x[i:j]), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    return [*by_definition(x, a, best[1]), (best[1], best[2]), *by_definition(x, best[2], b)]


def test_all_maximal_segments():
    rng = random.Random(31)
    for _ in range(1500):
        # The noise leaves no ties.
        w = np.array([rng.choice([0, 0, -1.5, -0.3, 0.7, 1.0, 2.5]) + rng.random() / 1e4 for _ in range(rng.randrange(0, 24))], float)
        got = toxicity.segments(w, 0.4)
        assert [(a, b) for a, b, _ in got] == by_definition((w - 0.4).tolist(), 0, len(w))
        assert all(s == pytest.approx(float((w[a:b] - 0.4).sum())) for a, b, s in got)


def test_time_is_linear():
    """Each candidate starts lower than the last, the slow case of a search that passes over none."""
    began = time.process_time()
    assert len(toxicity.segments(np.tile([0.03, 0, 0], 300_000))) == 300_000
    assert time.process_time() - began < 5


def test_one_training_row_an_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (3, None), (3, None), (4, "x"), (None, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (3, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    got = sorted((r.doc_id, r.text, r.label) for r in labelled.training_rows(docs, labels, "toxic").collect())
    assert got == [(1, "a", 1), (3, "", 0)]
    many = labelled.training_rows(docs.crossJoin(spark.range(50).select(F.col("id").alias("n"))).select("doc_id", "text"), labels, "toxic", sample=1)
    assert many.count() <= 1
