"""Connected components of a table of links, by least neighbour labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagwright.llm.common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) of the nodes of links (a, b): label is the least node reachable.

    Each round takes the least label of all neighbours, then the label of that label, so chains shorten
    by doubling. Labels are written out each round; groups are reduced before they are shuffled.
    """
    edges = materialize(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = materialize(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "cc-labels")
    while True:
        near = edges.join(labels.select("node", "label"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", labels["label"].alias("old"), F.least("label", "m").alias("label"))
        lower = materialize(lower, "cc-lower")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = materialize(lower.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")), "cc-labels")
        discard(labels, lower)
        if new.filter("old <> label").isEmpty():
            discard(edges)
            return new
        labels = new
