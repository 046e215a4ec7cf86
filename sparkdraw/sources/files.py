"""Drawings as binary files, format detection by content, and the gzip envelope."""

from __future__ import annotations

import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DrawingError, InvalidDrawing, LimitExceeded, UnsupportedDrawing
from .limits import Limits

#: Bytes that format detection looks at.
PROBE = 64 * 1024
_CHUNK = 64 * 1024
#: The first bytes of each envelope, as hexadecimal digits.
SIGNATURES = {"gzip": ("1F8B",), "unix_compress": ("1F9D",), "unix_pack": ("1F1E",), "zip": ("504B0304", "504B0506", "504B0708")}


def load(spark: SparkSession, paths: str | Iterable[str], limits: Limits = Limits(), glob: str | None = None) -> DataFrame:
    """(drawing_id, content, size) of files and folders, each path once.

    Files beyond max_file_size are pruned before their content is read; they keep a row with null content.
    """
    paths = [paths] if isinstance(paths, str) else sorted(set(paths))
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(paths)
    small = files.where(F.col("length") <= limits.max_file_size).select(F.col("path").alias("drawing_id"), "content", F.col("length").alias("size"))
    large = files.where(F.col("length") > limits.max_file_size).select(F.col("path").alias("drawing_id"), F.lit(None).cast("binary").alias("content"), F.col("length").alias("size"))
    return small.unionByName(large)


def compression(content: Column) -> Column:
    """The envelope that the first bytes name, or null."""
    start = F.hex(F.substring(content, 1, 4))
    out = F.when(F.lit(False), F.lit(""))
    for name, signs in SIGNATURES.items():
        hit = F.lit(False)
        for sign in signs:
            hit = hit | start.startswith(sign)
        out = out.when(hit, F.lit(name))
    header = F.conv(F.substring(start, 1, 4), 16, 10).cast("int")
    cmf = F.floor(header / 256).cast("int")
    zlib_like = (F.length(start) >= 4) & (cmf % 16 == 8) & (cmf < 128) & (header % 31 == 0)
    return out.when(zlib_like, F.lit("zlib"))


def detect_format(df: DataFrame, content: str = "content") -> DataFrame:
    """df with format (kind, compression, first_section, utf8_bom); kind is null if it is no drawing."""
    probe = F.substring(F.col(content), 1, PROBE)
    text = F.decode(probe, "ISO-8859-1")
    bom = text.startswith("ï»¿")
    body = F.when(bom, F.substring(text, 4, PROBE)).otherwise(text)
    mark = F.regexp_extract(body, r"\A[ \t\f\r\n]*#~([0-9]+)[ \t\f]*(?:[\r\n]|\z)", 1)
    number = F.when(mark != "", mark.try_cast("decimal(20,0)"))
    section = F.when(number <= 4294967295, number.cast("bigint"))
    envelope = compression(F.col(content))
    return df.withColumn(
        "format",
        F.when(section.isNotNull(), F.struct(F.lit("mi_text").alias("kind"), F.lit(None).cast("string").alias("compression"), section.alias("first_section"), bom.alias("utf8_bom")))
        .when(envelope.isNotNull(), F.struct(F.lit("compressed_candidate").alias("kind"), envelope.alias("compression"), F.lit(None).cast("bigint").alias("first_section"), F.lit(False).alias("utf8_bom"))),
    )


def opened(data: bytes | None, limits: Limits) -> bytes | None:
    """The logical bytes, null for a drawing that cannot be read."""
    try:
        return unwrap(bytes(data), limits)[0] if data is not None else None
    except DrawingError:
        return None


def envelope_of(data: bytes) -> str | None:
    """compression() for bytes at hand."""
    start = data[:4].hex().upper()
    for name, signs in SIGNATURES.items():
        if start.startswith(signs):
            return name
    if len(data) >= 2 and data[0] & 15 == 8 and data[0] < 128 and int.from_bytes(data[:2], "big") % 31 == 0:
        return "zlib"
    return None


def unwrap(data: bytes, limits: Limits) -> tuple[bytes, str | None]:
    """The logical bytes and the envelope; gzip has one member, nothing after it, and is bounded chunk by chunk."""
    if len(data) > limits.max_file_size:
        raise LimitExceeded(f"input bytes: {len(data)} over {limits.max_file_size}")
    name = envelope_of(data)
    if name is None:
        return data, None
    if name != "gzip":
        raise UnsupportedDrawing(f"{name} envelopes are not decoded")
    engine, out, total, rest = zlib.decompressobj(31), [], 0, data
    try:
        while not engine.eof:
            got = engine.decompress(rest, _CHUNK)
            rest = engine.unconsumed_tail
            total += len(got)
            if total > limits.max_decompressed_size:
                raise LimitExceeded(f"decompressed bytes: over {limits.max_decompressed_size}")
            if total > len(data) * limits.max_compression_ratio:
                raise LimitExceeded(f"compression ratio: over {limits.max_compression_ratio}")
            out.append(got)
            if not got and not rest and not engine.eof:
                raise InvalidDrawing("gzip stream ends early")
    except zlib.error as bad:
        raise InvalidDrawing(f"gzip stream is broken: {bad}") from None
    if engine.unused_data:
        raise InvalidDrawing("data after the gzip member")
    return b"".join(out), name
