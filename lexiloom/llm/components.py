"""Connected components of a graph that lies in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import discard, stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); the component is its least node.

    A label never grows and names a node of the same component. Each round looks up the label of
    every node's label; the least of these among the neighbours goes to the node and to the node that
    its label names, so whole trees move at once and the rounds grow with about the logarithm of a
    chain's length, in whatever order its nodes are named. Rounds go on until no label changes.
    Labels are written to the shared folder each round; hubs are partial aggregates and skewed joins.
    Null ends and loops link nothing.
    """
    pairs = edges.select("a", "b").filter("a <> b").distinct()
    both = stage(pairs.union(pairs.select("b", "a")).distinct(), "cc-edges")
    labels = stage(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")),
        "cc-labels",
    )
    while True:
        named = labels.select(F.col("node").alias("n2"), F.col("label").alias("up"))
        far = stage(labels.join(named, labels["label"] == named["n2"]).select("node", "label", "up"), "cc-far")
        near = both.join(far, both["b"] == far["node"]).groupBy("a").agg(F.min("up").alias("m"))
        least = stage(
            far.join(near, far["node"] == near["a"]).select("node", "label", F.least("up", "m").alias("l")), "cc-near"
        )
        lower = least.filter("l < label")
        discard(far)
        if lower.isEmpty():
            discard(both, least)
            out = labels.withColumnRenamed("label", "component")
            out._staged = labels._staged
            return out
        told = least.select("node", "l").union(lower.groupBy("label").agg(F.min("l")))
        before, labels = labels, stage(told.groupBy("node").agg(F.min("l").alias("label")), "cc-labels")
        discard(least, before)
