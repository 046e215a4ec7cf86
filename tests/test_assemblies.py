"""Children of assemblies, whose places depend on all before them."""

import random
import time

import pytest
from drawing import drawing, rec, section

import sparkdraw
from sparkdraw.operators.decode import children


def fields(placements, ordinal="9"):
    out = []
    for j, (members, target, matrix) in enumerate(placements):
        out += [*(["sep"] if j else []), "a", "b", "c", str(len(members)), *map(str, members), str(target), *map(str, matrix)]
    return [*out, ordinal]


def test_walk():
    rng = random.Random(1)
    for _ in range(200):
        made = [([rng.randrange(99) for _ in range(rng.choice([0, 0, 1, 3]))], rng.randrange(99), [rng.random() for _ in range(9)]) for _ in range(rng.randrange(1, 9))]
        flat = fields(made)
        got = children(["x", *flat], 1, len(made))
        assert [(c["member_ids"], c["assembly_id"], c["transform_values"]) for c in got] == made
        assert [c["relation_value"] for c in got] == [None] + ["sep"] * (len(made) - 1) and all(c["definition_values"] == ["a", "b", "c"] for c in got)
        assert children(flat[:-1], 0, len(made)) is None and children([*flat, "0"], 0, len(made)) is None and children(flat, 0, len(made) + 1) is None
        at = rng.randrange(len(flat))
        broken = [*flat[:at], "NaN", *flat[at + 1 :]]
        assert (children(broken, 0, len(made)) is None) == (flat[at] not in ("a", "b", "c", "sep"))


@pytest.mark.parametrize("n", [100_000])
def test_many_children_take_linear_time(spark, n):
    unit = [1, 0, 0, 0, 1, 0, 0, 0, 1]
    body = fields([([], 20, unit)] * n)
    data = drawing(section(5, rec("ASSE", 10, 0, "Top", 0, 0, 0, 0, 0, n, *body), rec("ASSE", 20, 0, "Leaf", 0, 0, 0, 0, 0, 0), rec("ASSE", 30, 0, "Bad", 0, 0, 0, 0, 0, 2, *body[:16])))
    corpus = sparkdraw.read(spark, spark.createDataFrame([("d", bytearray(data))], "drawing_id string, content binary"))
    corpus.records.count()
    began = time.time()
    rows = {r.entity_id: r.n for r in corpus.assemblies.selectExpr("entity_id", "size(instances) AS n").collect()}
    assert rows == {10: n, 20: 0}
    took = time.time() - began
    print(took)
    assert took < 60
