"""Audits are counted piece by piece: what they return reads counts, not entities."""

from collections import Counter

import pytest
from drawing import STYLE, asse, drawing, rec, section

import sparkdraw

HATCHED = section(72, rec("HAT", 11, *STYLE, 0, 0, 0.5, 1), rec("COC", 12, *STYLE, 1, 0, 1, 99), rec("PFA", 13, 0, 11, 12, 0))
CASES = {
    "all": [drawing(section(6, "A\n"), section(5, asse(1, "B"), asse(2, "A", ["0", "0", "0", "0", 77, 1, 0, 0, 0, 1, 0, 0, 0, 1])), HATCHED, section(61, rec("P", 3, 0, 0), rec("P", 3, 1, 1), rec("ODD", 4, 1)))],
    "plain": [drawing(section(61, rec("P", 1, 0, 0)), section(62, rec("LIN", 2, *STYLE, 1, 9))), drawing(section(61, rec("P", "x", 0, 0)))],
}


def read(spark, name):
    rows = [(f"d{i}", bytearray(x)) for i, x in enumerate(CASES[name])]
    return sparkdraw.read(spark, spark.createDataFrame(rows, "drawing_id string, content binary"))


@pytest.mark.parametrize("name", CASES)
def test_audit_reads_counts(spark, name):
    corpus = read(spark, name)
    told, files = corpus.audit(), corpus.audit_files()
    assert told.inputFiles() and all("/counts-" in f for f in told.inputFiles())
    assert not any("/entities-" in f or "/bound-" in f for f in files.inputFiles())
    seen = Counter((r.drawing_id, r.code) for r in corpus.diagnostics.collect())
    by_code = Counter()
    for (_, code), n in seen.items():
        by_code[code] += n
    assert {r["item"]: r["count"] for r in told.where("metric = 'diagnostic_codes'").collect()} == by_code
    assert {(r.drawing_id, code): n for r in files.collect() for code, n in r.diagnostic_codes.items()} == seen
    metrics = {r.metric for r in told.collect()}
    hatched = {"hatch_pattern_present", "hatch_boundary_counts", "contour_unresolved_components"}
    assert metrics & hatched == (hatched if name == "all" else set())
    assert ("MI_UNBOUND_ASSEMBLY" in by_code, "MI_DUPLICATE_ENTITY_ID" in by_code, "MI_INVALID_ENTITY_ID" in by_code) == (name == "all", name == "all", name == "plain")
    corpus.close()
