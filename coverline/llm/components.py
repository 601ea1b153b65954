"""Connected components as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, keep


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b), as a kept table: label is the smallest node that can be reached.

    Each round takes the smallest label among a node and its neighbours, then follows labels one step (so long chains
    halve). Groups are only ever reduced to minima, so a node with many links needs no memory of its own. Links that
    repeat count once; a link with a null end or of a node with itself counts for nothing; without links there is no row.
    """
    both = keep(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        step = labels.join(near, "node", "left").select("node", F.col("label").alias("before"), F.least("label", F.coalesce("seen", "label")).alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = step.join(jump, "label", "left").select("node", "before", F.least("label", F.coalesce("further", "label")).alias("label"))
        step = keep(step, "labels")
        drop(labels)
        labels = step
        if step.where("label <> before").isEmpty():
            drop(both)
            return labels
