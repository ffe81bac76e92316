"""A bit filter over 64-bit keys: built by aggregation, tested in tasks.

It has ``BITS`` bits, or as many as ``bits_for`` finds for a number of keys, up to
``MOST_BITS``, which bounds what is collected and broadcast.  A fuller filter lets more
non-members through; callers verify members by exact joins, so that changes how much
they move and never the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.llm import common

BITS, MOST_BITS = 1 << 24, 1 << 28
_BITS_PER_KEY = 12


def bits_for(n: int) -> int:
    """A power of two that lets about one non-member in forty through, within bounds."""
    return min(MOST_BITS, max(BITS, 1 << (_BITS_PER_KEY * n - 1).bit_length())) if n else BITS


def build(keys: DataFrame, key: Column, size: int = BITS) -> np.ndarray:
    """keys: rows with a well-mixed long; size: a power of two of bits.  At most
    size / 64 rows are collected."""
    low = F.lit(size - 1).cast("long")
    places = F.array(key.bitwiseAND(low), F.shiftrightunsigned(key, 32).bitwiseAND(low))
    at = keys.select(F.explode(places).alias("at"))
    bits = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    rows = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return out


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    keys = keys.astype(np.uint64, copy=False)
    low = np.uint64(64 * len(bits) - 1)
    out = np.ones(len(keys), bool)
    for shift in (0, 32):
        at = (keys >> np.uint64(shift)) & low
        out &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def passing(rows: DataFrame, key: Column, sent, hit: bool = True) -> DataFrame:
    """The rows whose key the broadcast filter may hold (``hit``), or surely does not."""

    def run(batches):
        for batch in batches:
            found = may_hold(sent.value, batch.column(batch.num_columns - 1).to_numpy().view(np.uint64))
            yield batch.filter(pa.array(found == hit)).select(list(range(batch.num_columns - 1)))

    return rows.withColumn("_key", key).mapInArrow(common.lean(run), rows.schema)
