"""Which things are linked, over however many steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverline.sources.kept import keep


def components(links: DataFrame) -> DataFrame:
    """(node, class_id) of every node of ``links`` (a, b): class_id is the smallest node of its class.

    A round takes for each node the smallest name that it or a neighbour knows, and then the name which that name knows, so
    long chains need few rounds; a node with many neighbours is only ever reduced to a minimum.
    """
    ends = keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct(), "links")
    names = keep(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("class_id")), "names")
    while True:
        heard = ends.join(names, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("class_id").alias("heard"))
        nearer = names.join(heard, "node").select("node", F.col("class_id").alias("before"), F.least("class_id", "heard").alias("class_id"))
        known = names.select(F.col("node").alias("class_id"), F.col("class_id").alias("further"))
        after = keep(nearer.join(known, "class_id", "left").select("node", "before", F.coalesce("further", "class_id").alias("class_id")), "names")
        if after.where("class_id <> before").isEmpty():
            return after.select("node", "class_id")
        names = after.select("node", "class_id")
