"""Operator 3, token counts: heap-and-linked-list byte-pair merging.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a null id stays
null; repeated rows are counted row by row; extra columns are ignored; an empty
table gives no rows.  Whole texts are read, whatever their length.  Special
strings inside a text count one token each, the library's default.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm import bpe, common

COUNT_SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def token_counts(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): UTF-8 bytes and tokens.  No shuffle."""
    common.ship(docs.sparkSession)
    path, default_pattern = default_vocabulary()
    path, pattern = vocabulary or path, pattern or default_pattern

    def count(batches):
        counter = bpe.kept(bpe.MergeCounter, path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n_bytes = [len(t.encode()) if t else 0 for t in texts]
            n_tokens = [counter.count(t) if t else 0 for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, COUNT_SCHEMA)


def op3_token_counts(spark, sf_dir: str, limit: int = 512) -> DataFrame:
    counts = token_counts(common.table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
