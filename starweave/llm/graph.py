"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starweave.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``: label is the smallest node it reaches.

    Each round takes the smallest label among neighbours and then the label of that label, so the
    number of rounds grows with the logarithm of a component's width. Edges stay in one stored
    table; hubs are safe because neighbours meet in joins and partial minimums, never in a list.
    """
    both = edges.select("a", "b").unionAll(edges.selectExpr("b as a", "a as b")).filter("a <> b").distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                    .select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m")))
        step = stored(labels.join(near, "node").select(
            "node", F.col("label").alias("was"), F.least("label", "m").alias("label")), "labels")
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = stored(step.join(jump, "label").select(
            "node", F.least("label", "further").alias("label"), "was"), "labels")
        labels = new.select("node", "label")
        if new.filter("label <> was").isEmpty():
            return labels
