"""Silver: normalised identity fields, one schema, staging numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.functions import text as T
from confluo.session import cut
from confluo.sources.systems import COMMON, IDENTIFIERS, IDENTITY, Source

NORMALISE = {
    "first_name": T.normalise_name, "surname": T.normalise_name, "full_name": T.normalise_name, "email": T.normalise_email,
    "phone": T.normalise_phone, "address": T.normalise_address, "postcode": T.normalise_postcode, "date_of_birth": T.normalise_date,
}


def standardise(bronze: DataFrame, source: Source) -> DataFrame:
    """One projection: absent identifiers as "", raw and normalised identity fields,
    then the source's own columns."""
    raw: dict[str, Column] = {f: F.col(c) for f, c in source.fields.items()}
    if "full_name" not in raw and "first_name" in raw:
        raw["full_name"] = T.combine_names(raw["first_name"], raw["surname"])
    ids = [(F.col(c) if c in bronze.columns else F.lit("")).alias(c) for c in IDENTIFIERS]
    value = lambda f: F.coalesce(raw.get(f, F.lit("")), F.lit(""))
    raws = [value(f).alias(f"{f}_raw") for f in IDENTITY]
    normal = [(NORMALISE[f](value(f)) if f in raw else F.lit("")).alias(f"{f}_normalised") for f in IDENTITY]
    extras = [c for c in bronze.columns if c not in COMMON]
    return bronze.select("source_system", "source_record_id", *ids, *raws, *normal, *extras)


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames over the ordered union of their columns; absent is ""."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).na.fill("")


def consolidate(frames: list[DataFrame]) -> DataFrame:
    ranked = [f.withColumn("_rank", F.lit(i)) for i, f in enumerate(frames)]
    return numbered(union_sources(ranked), ["_rank", "source_record_id"], "staging_record_id", "STG").drop("_rank")


def numbered(df: DataFrame, order: list, name: str, prefix: str, digits: int = 6) -> DataFrame:
    """Consecutive technical ids in ``order``, in front.  Rows are range-partitioned;
    a task numbers its own rows and adds the sizes of the ranges before it, so nothing
    passes through a single partition but one count per range."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(df.sparkSession.sparkContext.defaultParallelism, *by).sortWithinPartitions(*by)
    local = cut(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id()), "numbered")
    sizes = local.groupBy("_part").agg(F.count("*").alias("_rows"), F.min("_n").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    number = F.col("_n") - F.col("_first") + F.col("_offset") + 1
    return local.join(F.broadcast(offsets), "_part").select(F.format_string(f"{prefix}%0{digits}d", number).alias(name), *df.columns)
