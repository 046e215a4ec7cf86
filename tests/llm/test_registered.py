"""The registered queries and the pipeline, on the smallest tables."""

import hashlib
import os
import zlib

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_operators import awkward, by_brute_force, component_of, library
from test_secret_battery import base_by_hand

from sparkdraw.llm import secrets
from sparkdraw.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.fixture(scope="module")
def texts(db):
    return dict(db.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def result(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, DATA).collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, db, name):
    got, want = QUERIES[name](spark, DATA).toArrow(), db.sql(ORACLE_SQL[name]).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    rows = lambda t: sorted(map(repr, zip(*[t.column(n).to_pylist() for n in names], strict=True)))
    assert rows(got) == rows(want)


def test_op1_and_op10(spark, texts, db):
    for name, label, least in (("op1_quality", "quality", 0.3), ("op10_toxicity", "toxic", 0.5)):
        rows = result(spark, name)
        assert set(rows) == set(texts)
        assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= least) for d, r in rows.items())
        known = {d: y for d, y in db.sql(f"SELECT doc_id, {label} FROM labels").fetchall() if rows[d].held_out}
        # Only rows that no model has learned from count.
        assert len(known) >= 10 and np.mean([rows[d].predicted == y for d, y in known.items()]) > 0.8


def test_op2(spark, texts):
    other = library(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = result(spark, "op2_bpe")
    for d, t in texts.items():
        ids = other.encode_ordinary(t)
        assert (rows[d].n_tokens, rows[d].ids_sha256, rows[d].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_op3(spark, texts):
    rows = result(spark, "op3_media")
    for d, t in texts.items():
        raw = t.encode()
        full = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (rows[d].n_bytes, rows[d].payload_bytes, rows[d].payload_sha256, rows[d].tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))


def test_op4(spark, texts):
    check_packing(QUERIES["op4_packing"](spark, DATA).collect(), texts)


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    of, within = {}, {}
    for r in rows:
        of.setdefault(r.doc_id, []).append(r)
        within.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(of) == set(texts)
    for d, mine in of.items():
        ids, at = np.array([*other.encode(texts[d], add_special_tokens=False).ids, 2], "<u4"), 0
        for i, r in enumerate(sorted(mine, key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (i, at, zlib.crc32(ids[at : at + r.length].tobytes())) and (r.length == 1024 or i == 0)
            at += r.length
        assert at == len(ids)
    total = 0
    for spans in within.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
        total += at
    assert len(within) <= 1.01 * total / 1024 + 1


def test_op5(spark, texts):
    rows = result(spark, "op5_minhash")
    want = {d: (n, c) for d, n, c in component_of(list(texts.items()))}
    assert {d: (r.n_shingles, r.component_id) for d, r in rows.items()} == want and all(r.kept == (d == r.component_id) for d, r in rows.items())


def test_op7(spark, texts):
    rows = result(spark, "op7_secrets")
    for d, t in texts.items():
        base = base_by_hand(t)
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert rows[d].base_sha256 == hashlib.sha256(said.encode()).hexdigest() and (rows[d].n_assign, rows[d].n_access, rows[d].n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))


def test_op8(spark, texts):
    from sparkdraw.llm import packing

    rows = result(spark, "op8_lm_scoring")
    encode = packing.byte_level_tokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)()
    ids = encode(list(texts.values()))
    want = dict(zip(texts, zip(map(len, ids), brute.stupid_backoff(ids, 3, 2), strict=True), strict=True))
    assert set(rows) == set(texts)
    assert all(r.n_tokens == want[d][0] and r.log_score == pytest.approx(want[d][1], abs=1e-4) for d, r in rows.items())


def covered(text):
    """The text with every found stretch as one mark, by a flag for each character."""
    base = base_by_hand(text)
    hidden = bytearray(len(text))
    for a, _, b in base + secrets.random_spans(text, base):
        hidden[a:b] = b"\1" * (b - a)
    starts = {a for a, _, _ in base} | {a for a, _, _ in secrets.random_spans(text, base)}
    out = []
    for i, x in enumerate(text):
        if not hidden[i]:
            out.append(x)
        elif i in starts and (i == 0 or not hidden[i - 1] or not any(a < i < b for a, _, b in base)):
            out.append("<secret>")
    return "".join(out)


def test_pipeline(spark, texts):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, dict(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = corpus_pipeline.staged(stage(spark, docs, DATA), name)
        assert rows.columns == columns
        got = {r.doc_id: r.text for r in rows.collect()}
        items = sorted(kept.items())
        if name == "toxicity":
            said = result(spark, "op10_toxicity")
            want = {d: t for d, t in items if not said[d].predicted}
            assert 0.8 * len(items) <= len(want)
        elif name == "exact_dedup":
            want = {d: kept[d] for d in {v[0] for v in by_brute_force(items).values()}}
        elif name == "minhash_near_dedup":
            want = {d: kept[d] for d, _, c in component_of(items) if d == c}
        else:
            want = {d: covered(t) for d, t in items}
        assert got == want
        docs, kept = rows, got
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect(), kept)
    assert corpus_pipeline.run(spark, DATA).count() == corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count()


@pytest.mark.parametrize("some", [True, False])
def test_pipeline_stages_on_awkward_rows(spark, some):
    """Nulls in any column, empty and very long texts, repeated rows, clashing columns, and no rows at all."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = awkward(spark).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.lit(None).cast("long")})
    docs = docs if some else docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = corpus_pipeline.staged(stage(spark, docs, DATA), name)
        assert made.columns == docs.columns and [f.dataType for f in made.schema] == [f.dataType for f in docs.schema]
        assert (made.count() > 0) == some
        docs = made
    assert (corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() > 0) == some
