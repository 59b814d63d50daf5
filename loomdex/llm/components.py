"""Connected components of a table of links, all in Spark.

Each round points every node at its smallest neighbour, follows the pointers
to their roots, and contracts the links to roots; a graph of n nodes shrinks
at least by half a round.  Nothing is collected but counts of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link, component being the smallest
    node that it reaches.  Loops and repeated links are allowed; no links give
    no rows.  The nodes of a link must not be null."""
    low, high = F.least(a, b).alias("a"), F.greatest(a, b).alias("b")
    edges = scratch.write(links.select(low, high).where("a < b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), "b").union(edges.select(F.col("b").alias("node"), F.col("a").alias("b")))
        parents = both.groupBy("node").agg(F.least(F.col("node"), F.min("b")).alias("parent"))
        parents = scratch.write(parents, "parents")
        while True:  # pointer jumping; the pointers lead to smaller nodes, so there are no cycles
            up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
            further = parents.select(F.col("node").alias("next"), F.col("parent").alias("root"))
            jumped = parents.join(up, "parent").join(further, "next")
            jumped = jumped.select("node", F.col("root").alias("parent"), (F.col("root") != F.col("parent")).alias("moved"))
            jumped = scratch.write(jumped, "jumped")
            scratch.drop(parents)
            parents = jumped.select("node", "parent")
            parents._loomdex_path = jumped._loomdex_path
            if jumped.where("moved").isEmpty():
                break
        at = lambda name: parents.select(F.col("node").alias(name), F.col("parent").alias(f"{name}_root"))
        moved = edges.join(at("a"), "a").join(at("b"), "b")
        moved = moved.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
        contracted = scratch.write(moved.where("a < b").distinct(), "edges")
        if labels is None:
            found = parents.select("node", F.col("parent").alias("component"))
            found._loomdex_path = parents._loomdex_path
            labels = found
        else:
            up = parents.select(F.col("node").alias("component"), F.col("parent").alias("root"))
            renamed = labels.join(up, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
            renamed = scratch.write(renamed, "labels")
            scratch.drop(labels, parents)
            labels = renamed
        scratch.drop(edges)
        edges = contracted
    scratch.drop(edges)
    if labels is None:
        kind = links.schema[a].dataType.simpleString()
        return links.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    return labels
