"""The registered n-gram query looks two tokens back, and ids that don't fit are refused."""

import brute
import numpy as np
import public_tokenizers
import pytest

from sparkdraw.llm import lm, packing
from sparkdraw.llm.queries import QUERIES

TEXTS = ["the cat sat on the mat and the cat sat on the hat", "a dog sat on the mat", "", "the cat sat there", "a dog ran on the hat and the cat sat on the mat"]


def test_op8_scores_trigrams(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.log_score for r in QUERIES["op8_lm_scoring"](spark, str(tmp_path)).orderBy("doc_id").collect()]
    encode = packing.byte_level_tokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)()
    ids = [np.asarray(x) for x in encode(TEXTS)]
    assert got == pytest.approx(brute.stupid_backoff(ids, 3, 2), abs=1e-5)
    assert got != pytest.approx(brute.stupid_backoff(ids, 2, 2), abs=1e-5)


def test_a_salted_table_over_many_partitions(spark, monkeypatch):
    """Partitions of some 50 tokens: frequent tokens are dealt several ways, and scores stay the same."""
    monkeypatch.setattr(lm, "PART_TOKENS", 50)
    texts = TEXTS * 7 + ["the the the the the"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    make = packing.byte_level_tokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    got = [r.log_score for r in lm.stupid_backoff(df, make).orderBy("doc_id").collect()]
    assert got == pytest.approx(brute.stupid_backoff(make()(texts), 3, 2), abs=1e-4)
    counts = np.zeros(lm.START + 1, np.int64)
    counts[5] = 1000
    dealing = lm.Dealing(counts, 40)
    grams = np.array([5 << 32 | u << 16 | w for u in range(20) for w in range(20)], np.uint64)
    goal = dealing.of_trigrams(grams)
    assert len(set(goal.tolist())) > 20
    for u, w, p in [(int(g) >> 16 & 0xFFFF, int(g) & 0xFFFF, p) for g, p in zip(grams.tolist(), goal.tolist(), strict=True)]:
        pairs = np.array([u << 16 | 5, 5 << 16 | w], np.uint64)
        place, parts = dealing.of_pairs(pairs)
        assert {0, 1} == {int(i) for i, q in zip(place, parts, strict=True) if q == p}


def test_ids_that_do_not_fit():
    assert lm.trigrams([np.array([0, lm.START - 1])])[0].tolist() == [0xFFFFFFFF0000, 0x0000FFFFFFFE]
    for wrong in (lm.START, 70_000):
        with pytest.raises(ValueError, match="below"):
            lm.trigrams([np.array([5, wrong])])
