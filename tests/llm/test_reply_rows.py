"""Reply trees with repeated nodes, rows without a node, and branches that share a beginning."""

from pyspark.sql import functions as F

from sparkdraw.llm import chat

SCHEMA = "tree string, node long, parent long, role string, text string, score double"


def told(made):
    rows = made.select("*", chat.read_turns(F.col("formatted")).alias("turns")).collect()
    return sorted(((r.tree or "", r["rank"], r.leaf or -1, r.n_turns, [(t.role, t.text) for t in r.turns]) for r in rows), key=str)


def test_repeated_nodes_count_once(spark):
    chain = [("t", i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"turn {i}", 1.0) for i in range(8)]
    once = told(chat.format_trees(spark.createDataFrame(chain, SCHEMA)))
    assert once == [("t", 1, 7, 8, [(r[3], r[4]) for r in chain])]
    assert told(chat.format_trees(spark.createDataFrame(chain * 2, SCHEMA))) == once
    # The least row of a node counts: a null parent before others, then role, then text.
    other = [("t", 3, 2, "assistant", "turn 9", 5.0), ("t", 5, 4, "zebra", "", 0.0)]
    assert told(chat.format_trees(spark.createDataFrame(chain + other, SCHEMA))) == once


def test_rows_without_a_node(spark):
    rows = [("t", None, None, "user", "a", 0.0), ("t", None, None, "user", "a", 0.0), ("t", None, 1, "user", "b", 2.0), ("t", 1, None, "user", "q", 1.0), (None, None, None, None, None, None)]
    got = told(chat.format_trees(spark.createDataFrame(rows, SCHEMA)))
    assert got == sorted([("", 1, -1, 1, [("", "")]), ("t", 1, -1, 1, [("user", "b")]), ("t", 2, 1, 1, [("user", "q")]), ("t", 3, -1, 1, [("user", "a")])], key=str)


def test_regenerations_are_ranked(spark):
    """Three answers to one question, one of them continued: branches share a beginning and rank by their sums."""
    rows = [("t", 1, None, "user", "q", 1.0), ("t", 2, 1, "assistant", "a", 3.0), ("t", 3, 1, "assistant", "b", 5.0), ("t", 4, 1, "assistant", "c", 3.0), ("t", 5, 4, "user", "more", 4.0)]
    made = chat.format_trees(spark.createDataFrame(rows, SCHEMA))
    assert [(r.leaf, r["rank"], r.score) for r in made.orderBy("rank").collect()] == [(5, 1, 8.0), (3, 2, 6.0), (2, 3, 4.0)]
    best = chat.format_trees(spark.createDataFrame(rows, SCHEMA), best=2)
    assert [r.leaf for r in best.orderBy("rank").collect()] == [5, 3]
