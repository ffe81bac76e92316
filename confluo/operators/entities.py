"""Entity numbers, mappings and cluster summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.functions import text as T
from confluo.operators.standardise import numbered


def number_clusters(mapping: DataFrame, prefix: str, name: str, record: str = "staging_record_id") -> DataFrame:
    """(cluster, name): clusters numbered by their least record."""
    least = mapping.groupBy("cluster").agg(F.min(record).alias("first"))
    return numbered(least, ["first", "cluster"], name, prefix).select("cluster", name)


def stable_ids(mapping: DataFrame, limit: int = 999_999) -> DataFrame:
    lookup = number_clusters(mapping, "UCR", "ucr_id")
    if lookup.count() > limit:
        raise ValueError(f"more than {limit} entities")
    return mapping.join(lookup, "cluster")


def status(size, methods) -> F.Column:
    return F.when(F.array_contains(methods, "FUZZY"), "probabilistically_linked").when(size > 1, "deterministically_linked").otherwise("unresolved_singleton")


def cluster_summary(mapping: DataFrame) -> DataFrame:
    """One row per entity: records, systems, lists; a cluster field with two values is
    an error that ``quality.constant_within`` reports."""
    return mapping.groupBy("ucr_id").agg(
        F.count("*").alias("record_count"),
        F.count_distinct("source_system").alias("source_count"),
        T.joined_list(F.col("source_system")).alias("source_systems"),
        T.joined_list(F.col("staging_record_id")).alias("records"),
        F.min("staging_record_id").alias("first_record"),
    )


def confidence(merged_edges: DataFrame) -> DataFrame:
    """Least accepted score of each merged cluster."""
    return merged_edges.groupBy("merged").agg(F.min("score").alias("confidence"))
