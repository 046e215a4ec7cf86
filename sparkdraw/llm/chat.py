"""Chat formatting of reply trees, in DataFrame operations only.

Nodes name their parents. Ancestors at distances of powers of two come from joining the table with
itself; each leaf then collects its ancestors from the farthest distance down, so a path of n nodes
takes about 2 log2(n) joins. Branches of a tree are ranked by the sum of their nodes' scores, and each
chosen path becomes one conversation.

Template: ``<turn role="R">``, newline, text, newline, ``</turn>``, newline. In texts and roles ``&``
and ``<`` (and ``"``) become entities, so no text can hold a mark, and unescaping gives it back.

A parent that is not in the tree makes its child a root. Null trees form a tree of their own, null
texts, roles count as empty and null scores as 0. A cycle of parents raises ValueError. Of rows that
repeat a tree and node the least by parent, role, text and score counts, the others do not. Rows
without a node can have no replies: each different one is a conversation of one turn, with a null leaf.

A path is put together in one task, as it becomes one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, owning, staged

_OPEN, _MID, _CLOSE = '<turn role="', '">\n', "</turn>\n"


def escape(text: Column) -> Column:
    """Reversible: no ``<`` and no ``"`` is left."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<"))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def linear_trees(rows: DataFrame, tree: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """Nodes (tree, node, parent, role, text, score) of conversations that are plain lists.

    Turns that tie in ``order`` go by role, then text; null orders come first.
    """
    by = Window.partitionBy(tree).orderBy(order, role, text)
    at = F.row_number().over(by).cast("long")
    return rows.select(F.col(tree).alias("tree"), at.alias("node"), F.col(role).alias("role"), F.col(text).alias("text")).select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def paths(nodes: DataFrame) -> DataFrame:
    """(key, leaf, node, back) for nodes with key, node, parent, each node once: every node of every root-to-leaf path and its distance from the leaf."""
    own = nodes.select("key", "node")
    step = nodes.where(F.col("parent").isNotNull()).select("key", "node", F.col("parent").alias("up"))
    known = own.select("key", F.col("node").alias("up"))
    jumps = [staged(step.join(known, ["key", "up"], "left_semi").select("key", "node", "up"), "jumps")]
    most = None
    while not jumps[-1].isEmpty():
        most = most or own.count()
        if 2 ** (len(jumps) - 1) > most:
            discard(*jumps)
            raise ValueError("parents form a cycle")
        last = jumps[-1]
        onward = last.select("key", F.col("node").alias("up"), F.col("up").alias("far"))
        jumps.append(staged(last.join(onward, ["key", "up"]).select("key", "node", F.col("far").alias("up")), "jumps"))
    parents = jumps[0].select("key", F.col("up").alias("node")).distinct()
    found = staged(own.join(parents, ["key", "node"], "left_anti").select("key", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back")), "paths")
    for k in reversed(range(len(jumps) - 1)):
        far = found.join(jumps[k], ["key", "node"]).select("key", "leaf", F.col("up").alias("node"), (F.col("back") + 2**k).alias("back"))
        last, found = found, staged(found.unionByName(far), "paths")
        discard(last)
    discard(*jumps)
    return found


def format_trees(nodes: DataFrame, best: int | None = None, learn: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, score, n_turns, formatted, loss_spans) for each path, or the ``best`` of a tree.

    nodes: tree, node, parent, role, text, score. loss_spans are the stretches (start, end: code points)
    of ``formatted`` that hold texts of the role ``learn``.
    """
    key = F.when(F.col("tree").isNull(), "").otherwise(F.concat(F.lit("="), F.col("tree").cast("string")))
    given = nodes.select(
        key.alias("key"), "tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    row = F.struct("parent", "role", "text", "score", "tree")
    named = given.where("node is not null").groupBy("key", "node").agg(F.min(row).alias("r")).select("key", "r.tree", "node", "r.parent", "r.role", "r.text", "r.score")
    nodes = staged(named, "nodes")
    joined = paths(nodes)
    alone = given.where("node is null").withColumn("lone", F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)).dropDuplicates(["key", "lone"])
    alone = alone.select("key", "tree", F.col("node").alias("leaf"), F.lit(0).cast("long").alias("back"), "lone", "role", "text", "score")
    turns = joined.withColumn("lone", F.lit("")).join(nodes.drop("parent"), ["key", "node"]).select(*alone.columns).unionByName(alone)
    head = F.concat(F.lit(_OPEN), escape(F.col("role")), F.lit(_MID))
    body = escape(F.col("text"))
    turns = turns.select("key", "tree", "leaf", "lone", "back", "score", head.alias("head"), body.alias("body"), (F.col("role") == learn).alias("learn"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit("\n" + _CLOSE)))
    path = Window.partitionBy("key", "leaf", "lone").orderBy(F.desc("back"))
    before = F.coalesce(F.sum(F.length("piece")).over(path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = before + F.length("head")
    turns = turns.withColumn("span", F.when(F.col("learn"), F.struct(start.cast("long").alias("start"), (start + F.length("body")).cast("long").alias("end"))))
    whole = turns.groupBy("key", "leaf", "lone").agg(
        F.first("tree").alias("tree"), F.sum("score").alias("score"), F.count("*").alias("n_turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "piece"))), lambda t: t.piece), "").alias("formatted"),
        F.array_sort(F.collect_list("span")).alias("loss_spans"),
    )
    ranked = whole.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "leaf", "lone")))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    return owning(ranked.select("tree", "leaf", "rank", "score", "n_turns", "formatted", "loss_spans"), nodes, joined)


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) of a formatted conversation."""
    parts = F.split(formatted, _CLOSE)

    def one(x: Column) -> Column:
        role = F.substring_index(F.substring(x, len(_OPEN) + 1, 1 << 30), '"', 1)
        begin = F.length(role) + (len(_OPEN) + len(_MID) + 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(x, begin, F.length(x) - begin)).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), one)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s.start.cast("int") + 1, (s.end - s.start).cast("int")))), "")
