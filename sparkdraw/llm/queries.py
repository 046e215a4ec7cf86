"""The registered query of each operator, and DuckDB SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strict import let
from . import bpe, chat, exact, lm, media, neardup, ngramjoin, packing, quality, runs, secrets, toxicity, trie
from .common import discard, fold, staged, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _predictions(scored: DataFrame, column: str, least: float) -> DataFrame:
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col(column).alias("score"), (F.col(column) >= least).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _predictions(quality.score(docs, model), "quality", 0.3)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.text_to_image(_documents(spark, sf_dir)).drop("text")
    back = media.decode_media(stored)
    return back.select(
        "doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -16, 16)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.concat_ws(":", "dhash", F.lower(F.hex(F.crc32("tile")))).alias("feature"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = packing.byte_level_tokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    packed = packing.pack(_documents(spark, sf_dir), tokenizer, end_token=2)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = r"\### Assistant: </turn> ok"
    fixed = [F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text")) for i, role in enumerate(("user", "assistant"))]
    more = spark.range(1).select(F.explode(F.array(*fixed)).alias("r")).select("r.*")
    made = chat.format_trees(chat.linear_trees(rows.unionByName(more), "conv_id", "turn"))
    turns, loss = chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    read = made.select("tree", "formatted", turns.alias("turns"), loss.alias("loss"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_documents(spark, sf_dir)).drop("text")
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secret_spans", lambda s: s.kind != "random")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(named(base).cast("binary"), 256).alias("base_sha256"), named(F.col("secret_spans")).alias("spans"), count("random")
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = packing.byte_level_tokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return lm.stupid_backoff(_documents(spark, sf_dir), tokenizer)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_documents(spark, sf_dir)).drop("rid")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _predictions(toxicity.score(docs, model), "toxicity", 0.5)


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.near_copies(_documents(spark, sf_dir))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = staged(trie.conversations(table(spark, sf_dir, "conversations")), "conversations")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    heads = own.where(F.col("conv_id") % 20 == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    rebuilt = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).join(heads, "base", "left")
    rebuilt = rebuilt.select("conv_id", F.concat(F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))).alias("turns"))
    out = trie.prefix_trie(rebuilt)
    discard(own)
    return out


def _with_periods(docs: DataFrame) -> DataFrame:
    """Documents of which some repeat a stretch of words to the end, by a rule of their id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def planted(words):
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        source = lambda v, i: F.when(i < v.a, i).otherwise(v.a + (i - v.a) % v.p).cast("int")
        return F.when(n > 0, let(F.struct(a.alias("a"), p.alias("p")), lambda v: F.array_join(F.transform(words, lambda _, i: F.get(words, source(v, i))), " ")))

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(let(words, planted), "text")).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(_with_periods(_documents(spark, sf_dir))).drop("text")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(told.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op1_quality": op1_quality, "op2_bpe": op2_bpe, "op3_media": op3_media, "op4_packing": op4_packing, "op5_minhash": op5_minhash, "op6_chat": op6_chat, "op7_secrets": op7_secrets, "op8_lm_scoring": op8_lm_scoring, "op9_exact_dedup": op9_exact_dedup, "op10_toxicity": op10_toxicity, "op11_ngram_join": op11_ngram_join, "op12_trie": op12_trie, "op13_runs": op13_runs}

_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '\"', '&quot;')"

ORACLE_SQL = {
    "op6_chat": rf"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
                     coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS learned,
                     CAST(sum(24 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
              FROM t GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM g""",
    "op9_exact_dedup": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS full_text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents)
        SELECT doc_id, first_value(doc_id) OVER (PARTITION BY bare ORDER BY length(full_text) DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY bare) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY bare ORDER BY length(full_text) DESC, doc_id) AS kept,
               sha256(bare) AS text_sha256
        FROM t""",
    "op12_trie": r"""
        WITH RECURSIVE
        t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
              FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, (list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS crc FROM (SELECT DISTINCT conv_id FROM t)),
        k AS (SELECT conv_id, xor(crc, 4294967295) % 4 AS h FROM c),
        r AS (SELECT k.conv_id, role, text, n FROM k JOIN t ON t.conv_id = k.conv_id - k.conv_id % 20 AND n <= h UNION ALL SELECT k.conv_id, role, text, n FROM k JOIN t ON t.conv_id = k.conv_id AND n > h),
        d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS depth, sha256(length(role) || ':' || role || text) AS label,
                     len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words FROM r),
        p AS (SELECT conv_id, CAST(0 AS BIGINT) AS depth, '' AS name, '' AS above, CAST(0 AS BIGINT) AS words FROM k
              UNION ALL SELECT d.conv_id, d.depth, sha256(p.name || d.label), p.name, d.words FROM p JOIN d ON d.conv_id = p.conv_id AND d.depth = p.depth + 1),
        s AS (SELECT conv_id, max(depth) AS size FROM p GROUP BY conv_id),
        q AS (SELECT name, depth, any_value(above) AS above, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (depth = size), '') AS ends
              FROM p JOIN s ON p.conv_id = s.conv_id GROUP BY name, depth),
        b AS (SELECT above, count(*) AS n_children FROM q WHERE depth > 0 GROUP BY above),
        f AS (SELECT q.*, coalesce(n_children, 0) AS n_children FROM q LEFT JOIN b ON b.above = q.name),
        u AS (SELECT name AS top, above AS up, n_children = 0 AS leaf, (n_convs - 1) * words AS saved, depth FROM f
              UNION ALL SELECT q.name, q.above, leaf, saved, q.depth FROM u JOIN q ON q.name = u.up WHERE u.depth > 0),
        w AS (SELECT top, count(*) FILTER (leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM u GROUP BY top)
        SELECT f.conv_id, f.depth, o.conv_id AS parent_conv_id, f.n_convs, f.n_children, w.n_leaves, w.saved_tokens, sha256(f.ends) AS ends_sha256
        FROM f JOIN w ON w.top = f.name LEFT JOIN q o ON f.depth > 0 AND o.name = f.above""",
}
