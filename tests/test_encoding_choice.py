"""Encodings settled by aggregation equal those of plain calls."""

import itertools

import sparkdraw
from drawing import asse, drawing, head, rec, section, tex
from plain_encoding import detect


def test_every_combination(spark):
    """Marks, versions, declarations and texts at several places, in one corpus."""
    texts = [b"plain", "é".encode(), b"\x82\xa0", b"\xff", b"\xb1"]
    rows, want = [], {}
    for i, (bom, version, declared, name, part) in enumerate(itertools.product([False, True], ["2.10", "3.4", "3.20", "x.30"], [None, "sjis", "martian", "UTF 8"], texts, texts[:4])):
        parts = [section(1, f"ENCODING: {declared}\n")] if declared else []
        data = drawing(*parts, head(version, "NAME"), section(5, asse(10, "PART")), section(6, "PART\n"), section(62, rec(*tex(9, "word"))))
        data = (b"\xef\xbb\xbf" if bom else b"") + data.replace(b"NAME", name).replace(b"PART", part)
        rows.append((str(i), bytearray(data)))
        want[str(i)] = detect(None, bom, version, declared, [name, part, part])
    corpus = sparkdraw.read(spark, spark.createDataFrame(rows, "drawing_id string, content binary"))
    got = {r.drawing_id: (r["name"], r.source, r.code) for r in corpus.encodings.collect()}
    assert got == want
    names = {r.drawing_id: r["name"] for r in corpus.part_names.collect()}
    assert sum(v is None for v in names.values()) > 50 and len(names) == len(rows)
