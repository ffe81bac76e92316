"""Connected components over an edge table, without driver-side state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm.common import materialise


def components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node
    reachable.  Alternates the large-star and small-star contractions until the edge
    set stays the same, which takes a logarithmic number of rounds.  Minima are
    pre-aggregated and written before they are joined, so that a node with very many
    edges is split by adaptive execution rather than held by one task."""
    u, v = F.col(left).cast("long"), F.col(right).cast("long")
    e = materialise(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    seen = None
    while (sign := tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())) != seen and sign[0]:
        seen = sign
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialise(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        e = materialise(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select("v", "v").distinct())
