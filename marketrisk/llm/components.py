"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketrisk.llm.shared import materialised


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b); the label is the smallest node that can be reached.

    Each round takes the smallest label among the neighbours and then the label's own label, so the rounds grow
    with the logarithm of a component's diameter.  Every round is written to the shared folder.
    """
    both = materialised(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = materialised(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        nearest = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(nearest, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        lower = materialised(lower)
        owner = lower.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = materialised(lower.join(owner, "label").select("node", "old", F.least("label", "up").alias("label")))
        if jumped.filter("label < old").isEmpty():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (cls, comp) after links (a, b) between classes have joined their components."""
    of_a = labels.select(F.col("cls").alias("a"), F.col("comp").alias("x"))
    of_b = labels.select(F.col("cls").alias("b"), F.col("comp").alias("y"))
    between = links.join(of_a, "a").join(of_b, "b").filter("x <> y")
    joined = components(between.select(F.col("x").alias("a"), F.col("y").alias("b")))
    moved = labels.join(joined, F.col("comp") == F.col("node"), "left")
    return materialised(moved.select("cls", F.coalesce("label", "comp").alias("comp")))
