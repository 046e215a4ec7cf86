"""Connected components of an undirected graph, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, owning, staged


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the least node of each node's component, for nodes that have a link.

    Each round takes the least label among a node and its neighbours, then jumps to that label's own
    label; rounds grow with the logarithm of a component's diameter on paths, and stars need two. Rounds
    are written to the shared folder. Empty links give an empty result.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(F.col(b).alias("u"), F.col(a).alias("v")))
    both = staged(both.where("u <> v").distinct(), "links")
    step = staged(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label"), F.lit(True).alias("moved")), "labels")
    while True:
        labels = step.select("node", "label")
        near = both.join(labels, both.v == labels.node).select(F.col("u").alias("node"), "label", F.lit(None).cast(labels.schema["label"].dataType).alias("was"))
        least = near.unionByName(labels.withColumn("was", F.col("label"))).groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was"))
        roots = least.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = least.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label"), "was")
        last, step = step, staged(jumped.select("node", "label", (F.col("label") != F.col("was")).alias("moved")), "labels")
        discard(last)
        if step.where("moved").isEmpty():
            discard(both)
            return owning(step.select("node", "label"), step)
