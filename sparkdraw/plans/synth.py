"""Drawings written from tables, with string functions only; for round-trip queries and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A style without properties: colour, line type, weight, display code, property count.
STYLE = ("1", "0", "0.5", "9", "0")


def _text(x) -> Column:
    return x.cast("string") if isinstance(x, Column) else F.lit(str(x))


class many:  # noqa: N801
    """Marks an array column: each element is a field."""

    def __init__(self, array: Column):
        self.array = array.cast("array<string>")


def record(*fields) -> Column:
    """One framed record; ``many`` arrays take a field for each element."""
    flat = [f.array if isinstance(f, many) else F.array(_text(f)) for f in fields]
    return F.concat(F.array_join(F.concat(*flat), "\n"), F.lit("\n|~\n"))


def p(key, x, y) -> Column:
    return record("P", key, x, y)


def lin(key, a, b, style: tuple = STYLE) -> Column:
    return record("LIN", key, *style, a, b)


def cir(key, center, rim, style: tuple = STYLE) -> Column:
    return record("CIR", key, *style, center, rim)


def arc(key, center, start, end, orientation=0, kind: str = "ARC") -> Column:
    return record(kind, key, *STYLE, center, start, end, orientation)


def assp(key, *strings) -> Column:
    return record("ASSP", key, len(strings), *strings)


def asse(key, name, children: Column | None = None, ordinal=0) -> Column:
    """An assembly; children: array of arrays (member ids array as strings first joined) from ``child``."""
    head = ("ASSE", key, 0, name, 0, 0, 0, 0, 0)
    if children is None:
        return record(*head, 0)
    body = F.flatten(F.transform(children, lambda c, i: F.when(i > 0, F.concat(F.array(F.lit("0")), c)).otherwise(c)))
    return record(*head, F.size(children), many(body), ordinal)


def child(assembly_id, tx, ty, members: tuple = (), matrix: tuple | None = None) -> Column:
    """Fields of one placement, translated by (tx, ty) or with nine numbers of its own."""
    m = matrix or (1, 0, tx, 0, 1, ty, 0, 0, 1)
    return F.array(*map(_text, (0, 0, 0, len(members), *members, assembly_id, *m)))


def global_section(version="2.10", name="synthetic") -> Column:
    """Body of section 3: 45 lines."""
    lines: list = [""] * 45
    lines[0], lines[7], lines[8], lines[10], lines[11], lines[12] = name, "1-Jan-26", "0:00:00", "synthetic writer", version, "2D"
    lines[13:17] = ["0", "10", "0", "10"]
    lines[20:24] = ["A4", "1", "mm", "RAD"]
    lines[29:45] = ["1" if i % 5 == 0 else "0" for i in range(16)]
    return F.concat(F.array_join(F.array(*map(_text, lines)), "\n"), F.lit("\n"))


def rows(df: DataFrame, drawing: Column, place, number, order: Column, *bodies: Column) -> DataFrame:
    """(drawing_id, place, number, ord, body): parts of sections; place orders the sections of a drawing."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(drawing.cast("string").alias("drawing_id"), as_col(place).cast("bigint").alias("place"), as_col(number).cast("int").alias("number"), order.cast("bigint").alias("ord"), F.concat(*bodies).alias("body"))


def drawings(*parts: DataFrame, newline: str = "\n", end: str = "##~~\n", mark: bytes = b"", charset: str = "UTF-8") -> DataFrame:
    """(drawing_id, content) of section parts; every drawing ends in ``end``. In ISO-8859-1 a character is a byte, whatever that byte means."""
    total = parts[0]
    for more in parts[1:]:
        total = total.unionByName(more)
    bodies = total.groupBy("drawing_id", "place", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "body"))), lambda v: v["body"]), "").alias("body"))
    whole = bodies.groupBy("drawing_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "number", "body"))), lambda s: F.concat(F.lit("#~"), s["number"].cast("string"), F.lit("\n"), s["body"])), "").alias("text"))
    text = F.concat("text", F.lit(end))
    if newline != "\n":
        text = F.replace(text, F.lit("\n"), F.lit(newline))
    return whole.select("drawing_id", F.concat(F.lit(mark), F.encode(text, charset)).alias("content"))


def head(df: DataFrame, drawing: Column, version="2.10", last: Column | None = None) -> DataFrame:
    """Sections 2 (with LAST, if given) and 3 for each drawing of df."""
    each = df.select(drawing.cast("string").alias("d"), *([last.alias("last")] if last is not None else [])).groupBy("d").agg(*([F.max("last").alias("last")] if last is not None else [F.lit(1).alias("one")]))
    out = rows(each, F.col("d"), -1, 3, F.lit(0), global_section(version))
    if last is not None:
        out = out.unionByName(rows(each, F.col("d"), -2, 2, F.lit(0), F.concat(F.lit("LAST:"), F.col("last").cast("string"), F.lit("\n"))))
    return out
