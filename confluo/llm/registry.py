"""The corpus queries and their SQL."""

from __future__ import annotations

from confluo.llm import mixing, oracles
from confluo.llm.embeddings import op8_embeddings
from confluo.llm.licenses import op2_licenses
from confluo.llm.media import op7_media
from confluo.llm.mixing import op1_mixing
from confluo.llm.packing import op5_packing
from confluo.llm.secrets import op6_secrets
from confluo.llm.simhash import op9_simhash
from confluo.llm.suffix_dedup import op10_suffix_dedup
from confluo.llm.token_counts import op3_token_counts
from confluo.llm.toxicity import op4_toxicity


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_mixing, op2_licenses, op3_token_counts, op4_toxicity, op5_packing,
    op6_secrets, op7_media, op8_embeddings, op9_simhash, op10_suffix_dedup, pipeline,
)}

ORACLE_SQL = {"op1_mixing": mixing.ORACLE_SQL, "op8_embeddings": oracles.EMBEDDINGS, "op10_suffix_dedup": oracles.SUFFIX_DEDUP}
