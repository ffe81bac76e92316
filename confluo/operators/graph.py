"""Connected components of an edge table whose nodes are any ordered type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.session import cut


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every node in an edge, component its least reachable node.

    Labels start at a node's least neighbour; each round a label takes the least label
    around it and then the label of that label, which halves distances."""
    a, b = F.col(left), F.col(right)
    both = cut(edges.select(a.alias("u"), b.alias("v")).unionAll(edges.select(b.alias("u"), a.alias("v"))).distinct(), "both")
    label = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("l")), "labels")
    while True:
        around = both.join(label.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("l").alias("m"))
        lower = cut(label.join(around, "u").select("u", "l", F.least("l", "m").alias("m")), "lower")
        jump = lower.select(F.col("u").alias("m"), F.col("m").alias("far"))
        after = cut(lower.join(jump, "m", "left").select("u", "l", F.least("m", F.coalesce("far", "m")).alias("n")), "jumped")
        if after.where("n < l").isEmpty():
            return label.select(F.col("u").alias("node"), F.col("l").alias("component"))
        label = after.select("u", F.col("n").alias("l"))
