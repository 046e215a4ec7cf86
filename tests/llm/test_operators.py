"""Each operator on awkward rows, and against brute force or the libraries it must agree with."""

import base64
import hashlib
import io
import json
import random
import string
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sparkdraw.llm import bpe, chat, exact, lm, media, neardup, packing, quality, secrets, toxicity
from sparkdraw.llm.components import connected_components

SCHEMA = "doc_id long, text string, kept boolean, ids string, quality double, toxicity double, n_shingles long, secret_spans string, `odd name` int"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))


def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and columns that clash with results."""
    texts = [(1, "alpha beta gamma delta epsilon zeta"), (2, "alpha  beta\tgamma delta epsilon zeta "), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, "aaaaaaaaaaaaaaaaaaaa" * 300), (8, "é日本語 \U0001f600 \x1c\x85 x"), (None, "null id"), (None, None), (9, "same"), (9, "same"), (10, "same")]
    return spark.createDataFrame([(i, t, True, "x", 0.5, 0.5, 7, "y", 3) for i, t in texts], SCHEMA)


def empty(spark):
    return awkward(spark).limit(0)


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# Byte-level BPE


def multi():
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def library(path, pattern):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bitmap():
    rng, have, bits = random.Random(1), set(), bpe.RankBitmap(50_256)
    for _ in range(3000):
        r = rng.choice([rng.randrange(50_256), *list(have)[:3]])
        (bits.discard if r in have else bits.add)(r)
        have ^= {r}
        assert bits.first() == min(have, default=-1)


def test_bpe_agrees_with_the_library():
    model, other = bpe.load(*multi()), library(*multi())
    rng = random.Random(2)
    parts = ["a", "ab", "é", "th", "ing", "1", " ", "  ", "\n", "日本", "\x1c", "\x85", "ß", "²", "Ⅷ", "\U0001f600", "'s", "'", "_", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(80))) for _ in range(400)] + ["a" * n for n in range(40)] + ["ab" * 4000, "x" * 9999, "".join(rng.choices("abcdeth", k=20_000))]
    got = model.encode_batch(texts)
    assert all(a.tolist() == other.encode_ordinary(t) for a, t in zip(got, texts, strict=True))
    assert all(model.decode(a) == t.encode() for a, t in zip(got, texts, strict=True))
    words = ["".join(rng.choices("abcdething", k=rng.randrange(1, 40))).encode() for _ in range(500)]
    assert all(model.encode_one(w) == other.encode_ordinary(w.decode()) for w in words)


def test_bpe_with_inverted_ranks():
    """A vocabulary in which a merge can make a pair of a lower rank than its own."""
    ranks = {bytes([i]): i + 100 for i in range(256)} | {b"ab": 90, b"abab": 10, b"bab": 20, b"aba": 15, b"ba": 95, b"abc": 5, b"cab": 7}
    model = bpe.Bpe(ranks, r"\S+|\s+")
    rng = random.Random(3)
    words = ["".join(rng.choices("abc", k=rng.randrange(1, 30))).encode() for _ in range(2000)]
    flat, sizes = model.encode_pieces(words)
    rows = np.split(flat, np.cumsum(sizes)[:-1])
    assert all(r.tolist() == naive(w, ranks) == model.encode_one(w) for r, w in zip(rows, words, strict=True))


def naive(word, ranks):
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)  # noqa: B905
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_bpe_rows(spark):
    rows = bpe.encode(awkward(spark), *multi()).collect()
    other = library(*multi())
    for r in rows:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == other.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")
    assert "odd name" in rows[0].asDict() and bpe.encode(empty(spark), *multi()).count() == 0


# Media


def test_images():
    rng = np.random.default_rng(0)
    pixels = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert (media.decode_image(media.encode_ppm(pixels)) == pixels).all() and (media.decode_image(media.encode_bmp(pixels)) == pixels).all()
    assert media.decode_netpbm(b"P2 # note\n2 1 # more\n9\n3 9").tolist() == [[3, 9]]
    assert media.decode_netpbm(b"P1\n3 1\n101").tolist() == [[0, 255, 0]] and media.decode_netpbm(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode_netpbm(b"P5\n1 1\n300\n\x01\x02").tolist() == [[258]]
    for bad in (b"", b"P6\n2 2\n255\nxx", b"P7\n1 1\n", b"P5\n0 1\n255\n", b"BM" + b"\0" * 60):
        with pytest.raises(ValueError):
            media.decode_image(bad)
    image = rng.random((13, 9))
    got = media.resize_area(image, 4, 5)
    fine = image.repeat(4, 0).repeat(5, 1).reshape(4, 13, 5, 9).mean((1, 3))
    assert np.allclose(got, fine) and media.resize_area(image, 1, 1)[0, 0] == pytest.approx(image.mean())
    tile = np.load(io.BytesIO(media.npy_tile(pixels)))
    assert tile.shape == (32, 32) and tile.dtype == np.uint8
    assert media.difference_hash(np.tile(np.arange(90.0), (8, 1))) == "f" * 16 and media.difference_hash(np.zeros((4, 4))) == "0" * 16


def test_bmp_palette():
    head = b"BM" + (0).to_bytes(4, "little") + b"\0" * 4 + (14 + 40 + 8).to_bytes(4, "little")
    info = b"".join(x.to_bytes(4, "little") for x in (40, 3, 1)) + b"\1\0\1\0" + b"".join(x.to_bytes(4, "little") for x in (0, 4, 0, 0, 2, 0))
    got = media.decode_bmp(head + info + b"\x01\x02\x03\0\xff\xfe\xfd\0" + b"\xa0\0\0\0")
    assert got.tolist() == [[[253, 254, 255], [3, 2, 1], [253, 254, 255]]]


def test_media_rows(spark):
    rows = media.decode_media(media.text_to_image(awkward(spark))).collect()
    for r in rows:
        raw = (r.text or "").encode()
        want = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert bytes(r.samples) == want and r.n_bytes == len(raw) and r.error is None
    assert media.decode_media(media.text_to_image(empty(spark))).count() == 0
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"P6 nonsense"))], "doc_id long, media binary")
    assert [r.error is not None for r in media.decode_media(odd).collect()] == [True, True]


# Packing


def test_packing(spark):
    rng = np.random.default_rng(1)
    for rule in ("norm", "dot"):
        cap = packing.Capacity(tokens=100, documents=3, attention=6000, weights=(1.0, 0.5, 0.5), rule=rule)
        packer = packing.Packer(cap)
        lengths = np.concatenate([rng.integers(1, 70, 300), rng.integers(1, 70, 200)])
        a, b = packer.add(lengths[:300]), packer.add(lengths[300:])
        seq, off = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        for s in set(seq.tolist()):
            mine = np.flatnonzero(seq == s)
            order = mine[np.argsort(off[mine])]
            assert lengths[mine].sum() <= 100 and len(mine) <= 3 and (lengths[mine] ** 2).sum() <= 6000
            assert (off[order] == np.concatenate(([0], np.cumsum(lengths[order])[:-1]))).all()
    assert packing.cut(1, 10) == [(0, 1)] and packing.cut(10, 10) == [(0, 10)] and packing.cut(21, 10) == [(0, 1), (1, 10), (11, 10)]
    plain = packing.Packer(packing.Capacity(tokens=1024))
    sizes = rng.integers(1, 1024, 4000)
    used = len(set(plain.add(sizes)[0].tolist()))
    assert used <= 1.02 * -(-sizes.sum() // 1024)


def test_packing_rows(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    make = packing.byte_level_tokenizer(path, public_tokenizers.PATTERN)
    rng = random.Random(4)
    texts = ["".join(rng.choices(string.printable + "éß日  ", k=rng.randrange(60))) for _ in range(300)] + ["<|endoftext|> x", LONG[:9000]]
    assert all(a.tolist() == other.encode(t, add_special_tokens=False).ids for a, t in zip(make()(texts), texts, strict=True))
    rows = packing.pack(awkward(spark), make, 2).collect()
    whole = {}
    for r in sorted(rows, key=lambda r: r.start):
        whole.setdefault(r.doc_id, []).append(np.frombuffer(bytes(r.ids), "<u4"))
    assert np.concatenate(whole[6]).tolist() == [*other.encode(LONG, add_special_tokens=False).ids, 2] and [x.tolist() for x in whole[3]] == [[2]] and len(whole[9]) == 2
    assert packing.pack(empty(spark), make, 2).count() == 0


# Exact dedup


def by_brute_force(rows):
    groups = {}
    for i, (doc, text) in enumerate(rows):
        groups.setdefault("".join(c for c in text or "" if c not in " \t\n\v\f\r"), []).append((-len(text or ""), doc is None, doc or 0, i))
    return {i: (rows[min(g)[3]][0], len(g), i == min(g)[3] or None, hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for *_, i in g}


@pytest.mark.parametrize("block", [4, 16384])
def test_exact_duplicates(spark, block):
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect() if r.text is None or len(r.text) < 10_000]
    rows += [(100 + i, "".join(rng.choices("ab \n", k=rng.choice([3, 9, 40])))) for i in range(300)] + [(900, "abcd" * 50), (901, "abcd " * 50), (902, "abcd" * 49 + "abce")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", F.lit(1))
    got = exact.exact_duplicates(df, block=block).collect()
    want = by_brute_force(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.keep_id is None, r.keep_id or 0, r.group_size, r.text_sha256) for r in got) == sorted((d is None, d or 0, w[0] is None, w[0] or 0, w[1], w[3]) for (d, _), w in ((rows[i], want[i]) for i in want))
    assert sum(r.kept for r in got) == len({w[3] for w in want.values()})
    assert exact.exact_duplicates(df.limit(0)).count() == 0


def test_drop_exact_duplicates(spark):
    kept = exact.drop_exact_duplicates(awkward(spark))
    assert kept.columns == awkward(spark).columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["2", "5", "6", "7", "8", "None", "9"])


# Near duplicates


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def component_of(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    roots = {}
    for i, (d, s) in enumerate(sets):
        if s and d is not None:
            roots[find(i)] = min(roots.get(find(i), d), d)
    return [(d, len(s), roots.get(find(i), d) if s else d) for i, (d, s) in enumerate(sets)]


def test_near_duplicates(spark):
    rng = random.Random(6)
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    for g in range(25):
        base = [f"{rng.choice(string.ascii_letters)}{rng.randrange(400)}" for _ in range(rng.choice([3, 6, 9, 30, 120]))]
        for i in range(12):
            words = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 18) + 1)):
                words[rng.randrange(len(words))] = f"z{rng.randrange(9999)}"
            rows.append((1000 + 40 * g + i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bands", F.lit(1))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted(component_of(rows), key=str)
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    kept = neardup.drop_near_duplicates(df.where("doc_id >= 1000"))
    assert kept.count() == len({c for d, _, c in component_of(rows) if (d or 0) >= 1000}) and kept.columns == df.columns


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (200, 199)], "a long, b long")
    got = dict(connected_components(links).collect())
    assert {got[i] for i in range(1, 41)} == {1} and got[101] == 100 and got[200] == 199 and connected_components(links.limit(0)).count() == 0


# Chat


def test_reply_trees(spark):
    nodes = [("t", 1, None, "user", "q <b>", 1.0), ("t", 2, 1, "assistant", 'a & "x"', 5.0), ("t", 3, 1, "assistant", "b", 2.0), ("t", 4, 3, "user", None, 9.0), ("t", 5, 77, None, "orphan", None), (None, 1, None, "user", "</turn>", 0.0), ("t", 6, 4, "assistant", "&lt;", 1.0)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double").withColumn("key", F.lit(1)).withColumn("rank", F.lit(1))
    made = chat.format_trees(df)
    rows = made.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    got = {(r.tree, r.leaf): ([(t.role, t.text) for t in r.turns], r.loss, r["rank"]) for r in rows}
    assert got["t", 2] == ([("user", "q <b>"), ("assistant", 'a & "x"')], 'a & "x"', 2)
    assert got["t", 6] == ([("user", "q <b>"), ("assistant", "b"), ("user", ""), ("assistant", "&lt;")], "b&lt;", 1)
    assert got["t", 5] == ([("", "orphan")], "", 3) and got[None, 1][0] == [("user", "</turn>")] and len(got) == 4
    assert {r.leaf for r in chat.format_trees(df, best=1).where("tree = 't'").collect()} == {6}
    assert chat.format_trees(df.limit(0)).count() == 0
    loop = spark.createDataFrame([("t", 1, 2, "user", "a", 0.0), ("t", 2, 1, "user", "b", 0.0)], "tree string, node long, parent long, role string, text string, score double")
    with pytest.raises(ValueError, match="cycle"):
        chat.format_trees(loop)


def test_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"t{i} <>&\"") for i in range(150)] + [(2, None, None, None), (2, 0, "user", "x"), (2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_trees(chat.linear_trees(df, "conv_id", "turn")).select("tree", chat.read_turns(F.col("formatted")).alias("turns"))
    got = {r.tree: [(t.role, t.text) for t in r.turns] for r in made.collect()}
    assert got[1] == [(r, t) for _, _, r, t in rows[:150]] and got[2] == [("", ""), ("user", "x"), ("user", "x")]


# Secrets


def test_secret_patterns():
    text = "Password: hunter22 pass token='abc' API-KEY=abcdefg api_key = 'Zz9+/=.-_' AKIA" + "Q" * 16 + " AKIAQ " + "0af" * 8 + " " + "0af" * 7 + " ſecret=abcdefg"
    got = [(s["kind"], text[s["start"] : s["end"]]) for s in secrets.spans_of(text)]
    assert got == [("assign", "Password: hunter22"), ("assign", "api_key = 'Zz9+/=.-_"), ("access", "AKIA" + "Q" * 16), ("hex", "0af" * 8)]
    for clean in ("internationalizationinternationalization", "https://example.com/a/long/path/with-some-words", "2024-01-02-2024-03-04", "A_CONSTANT_WITH_A_VERY_LONG_NAME", "x" * 5000, "", "yz" * 40):
        assert secrets.spans_of(clean) == []


def test_random_strings_are_found():
    rng = random.Random(7)
    hits = sum(any(s["kind"] == "random" for s in secrets.spans_of("see " + "".join(rng.choices(string.ascii_letters + string.digits, k=40)) + " there")) for _ in range(200))
    assert hits >= 195
    words = ["the", "quick", "brown", "river", "stone", "under", "light", "garden", "window", "paper"]
    assert sum(bool(secrets.spans_of("".join(rng.choices(words, k=8)))) for _ in range(500)) == 0
    assert secrets.chosen([(50.0, 40), (-1.0, 40), (float("-inf"), 20)]) == [True, False, False] and secrets.chosen([]) == []


def test_secret_rows(spark):
    rows = secrets.find_secrets(awkward(spark)).collect()
    assert {r.doc_id: [(s.kind, s.start, s.end) for s in r.secret_spans] for r in rows if r.secret_spans} == {7: [("hex", 0, 6000)]} and secrets.find_secrets(empty(spark)).count() == 0
    df = spark.createDataFrame([(1, "a token: 0123456789abcdef0123456789abcdef z"), (2, None), (3, "clean")], "doc_id long, text string")
    assert [r.text for r in secrets.redact_secrets(df).orderBy("doc_id").collect()] == ["a <secret> z", None, "clean"]


# Language model


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores(spark, order):
    make = packing.byte_level_tokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    rows = [(r.doc_id if r.doc_id is not None else -i, (r.text or "")[:3000] if r.text is not None else None) for i, r in enumerate(awkward(spark).collect())] + [(50, " a" * 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gram", F.lit(1)).repartition(3)
    got = sorted((r.doc_id, r.log_score) for r in lm.stupid_backoff(df, make, order=order).collect())
    want = sorted(zip([d for d, _ in rows], brute.stupid_backoff(make()([t or "" for _, t in rows]), order, 2), strict=True))
    assert [d for d, _ in got] == [d for d, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=1e-5)
    assert lm.stupid_backoff(df.limit(0), make).count() == 0


# Classifiers


def test_quality(spark):
    rng = random.Random(8)
    good = [" ".join(rng.choices(["stone", "river", "and", "the", "of", "light,", "paper."], k=60)) for _ in range(150)]
    junk = [" ".join(w + "###" for w in rng.choices(["stone", "river", "the"], k=60)) for _ in range(150)]
    docs = documents(spark, good + junk).unionByName(awkward(spark), allowMissingColumns=True)
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(None, 1), (5, None), (5, 1)], "doc_id long, quality int")
    model = quality.fit(docs.limit(300), labels)
    rows = quality.score(docs, model).collect()
    held = [r for r in rows[:300] if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all((r.quality >= 0.5) == (r.doc_id < 150) for r in held) and all(0 <= r.quality <= 1 for r in rows)
    assert quality.score(empty(spark), model).count() == 0
    flat = quality.fit(docs.limit(0), labels)
    assert {r.quality for r in quality.score(awkward(spark), flat).collect()} == {0.5}
    x = np.random.default_rng(9).random((2000, 3))
    xor = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only a pair of features tells
    assert ((quality.boost(x, xor).predict(x) >= 0.5) == (xor == 1)).mean() > 0.95


def test_segments():
    rng = random.Random(10)
    for _ in range(200):
        w = np.array([rng.choice([0.0, 0.0, 0.0, 1.0, 2.5]) for _ in range(rng.randrange(0, 40))])
        got = toxicity.segments(w, 0.4)
        best = max((float((w[a:b] - 0.4).sum()) for a in range(len(w)) for b in range(a + 1, len(w) + 1)), default=0.0)
        assert max((s for *_, s in got), default=0.0) == pytest.approx(max(0.0, best)) and toxicity.best_score(w, 0.4) == pytest.approx(max(0.0, best))
        assert all(a < b <= c for (a, b, _), (c, _, _) in zip(got, got[1:])) and all(s == pytest.approx(float((w[a:b] - 0.4).sum())) for a, b, s in got)  # noqa: B905


def test_toxicity(spark):
    rng = random.Random(11)
    plain = ["stone", "river", "garden", "window", "paper", "light", "under", "the", "of", "and"] + [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    texts = []
    for i in range(400):
        words = rng.choices(plain, k=80)
        if i % 4 == 0:
            for _ in range(4):
                words[rng.randrange(80)] = rng.choice(["Grumbleface", "wretchling", "zornkaa", "zornkab", "zornkac", "zornkad"])
        texts.append(" ".join(words))
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum((r.toxicity >= 0.5) == (r.doc_id % 4 == 0) for r in held)
    assert right >= 0.97 * len(held)
    one = next(r for r in rows if r.passages)
    assert any(w in one.text[one.passages[0].start : one.passages[0].end].lower() for w in ("grumble", "wretch", "zorn"))
    more = toxicity.score(awkward(spark), model).collect()
    assert all(0 <= r.toxicity < 0.5 and r.passages == [] for r in more) and toxicity.score(empty(spark), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert all(r.toxicity < 0.5 for r in toxicity.score(docs.limit(5), none).collect())


def test_tokenizer_file_is_a_rank_file():
    vocabulary = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))["model"]["vocab"]
    assert sorted(vocabulary.values()) == list(range(len(vocabulary)))
