"""Validation: each check returns the rows that break it, or one row of counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.functions.text import blank_to_null


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def protected_columns(df: DataFrame, words: tuple[str, ...] = ("ground_truth",)) -> list[str]:
    return [c for c in df.columns if any(w in c for w in words)]


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def blanks(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*[F.sum(F.when(blank_to_null(F.col(c)).isNull(), 1).otherwise(0)).alias(c) for c in columns])


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either that the other lacks, repeats counted."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def row_counts(stages: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [d.agg(F.count("*").alias("n")).select(F.lit(s).alias("stage"), "n") for s, d in stages.items()])


def constant_within(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Keys within which a column has several values; e.g. clusters of two births."""
    return df.groupBy(key).agg(*[F.count_distinct(blank_to_null(F.col(c))).alias(c) for c in columns]).where(" or ".join(f"{c} > 1" for c in columns))


def uncovered(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Rows with a raw value whose normalised form is blank, per field."""
    lost = lambda f: blank_to_null(F.col(f"{f}_raw")).isNotNull() & blank_to_null(F.col(f"{f}_normalised")).isNull()
    return df.agg(*[F.sum(F.when(lost(f), 1).otherwise(0)).alias(f) for f in fields])


def outside(df: DataFrame, low: float, high: float, *columns: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [~F.col(c).between(low, high) for c in columns]))


def reconcile(detail: DataFrame, summary: DataFrame, key: str, value: str, total: str) -> DataFrame:
    """Keys whose detail does not add up to the summary."""
    d = detail.groupBy(key).agg(F.round(F.sum(value), 2).alias("detail_total"))
    return d.join(summary.select(key, F.round(F.col(total), 2).alias("summary_total")), key, "full").where("not (detail_total <=> summary_total)")
