"""Operator 8, embedding near-duplicates: int8 tile products with error bounds.

Vectors of one label (and one length) are dealt into blocks by hash, and every pair
of blocks is one tile.  A tile multiplies int8 codes exactly.  With x = s q + r for
a unit vector x, scale s, codes q and quantisation error e = |r|, the cosine of two
unit vectors differs from s q . s' q' by at most e + e' + e e'; only pairs whose
upper bound reaches the threshold are computed again in double precision.  A tile
hands on, per vector, how many rows it links to and the smallest vector of its
component in the tile: never the pairs.

Exact copies of a vector are one class that carries its number of rows, so a vector
that makes up much of the table is one row of one tile.  A label that makes up much
of the table becomes many tiles.

Defined cases: a null, empty or zero vector, one with a null or non-finite
component, and a row with a null label or null vec_id link with nothing (n_links 0,
component_id = vec_id); repeated rows link with each other; vec_id is the row's key;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm import common
from confluo.llm.graph import components
from confluo.llm.simhash import forest

THRESHOLD = 0.98
TILE = 512
#: Covers the rounding of the bound's own double arithmetic.
SLACK = 1e-9
_AT_ONCE = 20_000


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and error norms of the rows of x, taken as unit vectors."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(x - codes * scale[:, None], axis=1)


def tile_links(x: np.ndarray, first: np.ndarray, within: bool, threshold: float = THRESHOLD) -> np.ndarray:
    """Symmetric boolean matrix of links among the rows of x.  ``first`` marks the
    rows of the tile's first block; unless ``within``, only pairs across count."""
    # squares of very large or small doubles would overflow, so scale rows first
    x = x / np.abs(x).max(axis=1, keepdims=True)
    codes, scale, error = quantise(x)
    exact = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
    a, b = (np.arange(len(x)),) * 2 if within else (np.flatnonzero(first), np.flatnonzero(~first))
    product = codes[a].astype(exact) @ codes[b].astype(exact).T
    bound = product * scale[a, None] * scale[None, b]
    bound += error[a, None] + error[None, b] + error[a, None] * error[None, b] + SLACK
    i, j = np.nonzero(bound >= threshold)
    i, j = a[i], b[j]
    if within:
        i, j = i[i < j], j[i < j]
    norm = np.linalg.norm(x, axis=1)
    out = np.zeros((len(x), len(x)), bool)
    for at in range(0, len(i), _AT_ONCE):
        p, q = i[at : at + _AT_ONCE], j[at : at + _AT_ONCE]
        near = np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q]) >= threshold
        out[p[near], q[near]] = out[q[near], p[near]] = True
    return out


def _keys(rows) -> np.ndarray:
    """The tiles of the rows of a batch or table: number of the label, both blocks."""
    return np.column_stack([rows.column(i).to_numpy() for i in range(3)])


def _tiles(threshold: float):
    """Rows come sorted by tile; the rows of a tile are held together."""

    def run(batches):
        def flush(rows: list[pa.RecordBatch]):
            t = pa.Table.from_batches(rows).combine_chunks()
            key = _keys(t)
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            out = [[], [], []]
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(key)]):
                part = t.slice(lo, hi - lo)
                node, weight = part.column("node").to_numpy(), part.column("weight").to_numpy()
                within = bool(part.column("within")[0].as_py())
                x = part.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(hi - lo, -1)
                links = tile_links(x, part.column("first").to_numpy(zero_copy_only=False), within, threshold)
                some = np.flatnonzero(links.any(axis=1))
                if len(some):
                    order = some[np.argsort(node[some])]
                    links = links[np.ix_(order, order)]
                    root = dict(forest(node[order], links))
                    out[0] += node[order].tolist()
                    out[1] += (links @ weight[order]).tolist()
                    out[2] += [root.get(int(n), int(n)) for n in node[order]]
            return pa.record_batch([pa.array(c, pa.int64()) for c in out], ["node", "links", "root"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = _keys(batch)
            new = np.flatnonzero((key != last).any(axis=1)) if held else key[:0, 0]
            if len(new):
                head = int(new[0])
                yield flush([*held, batch.slice(0, head)])
                held, batch, key = [], batch.slice(head), key[head:]
            other = np.flatnonzero((key != key[-1]).any(axis=1))
            if len(other):
                yield flush([batch.slice(0, int(other[-1]) + 1)])
                batch = batch.slice(int(other[-1]) + 1)
            held.append(batch)
            last = key[-1]
        if held:
            yield flush(held)

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links,
    component_id, kept."""
    common.ship(vectors.sparkSession)
    e = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0)
    good = rows.where(F.coalesce(usable, F.lit(False)))
    classes = common.materialise(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")), "vectors")
    size = F.size(e).alias("dim")
    counts = classes.groupBy("label", size).agg(F.count("*").alias("n"))
    # the number names a label and length in tiles; it is fixed once written
    counts = common.materialise(counts.withColumn("no", F.monotonically_increasing_id()), "labels")
    blocks = F.ceil(F.col("n") / TILE).cast("long")
    tiles = (
        classes.withColumn("dim", size)
        .join(counts, ["label", "dim"])
        .withColumn("block", F.pmod(F.xxhash64("embedding"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .withColumn("lo", F.least("block", "other"))
        .withColumn("hi", F.greatest("block", "other"))
        .select(
            "no", "lo", "hi", "node", "weight", "embedding",
            (F.col("block") == F.col("lo")).alias("first"), (F.col("lo") == F.col("hi")).alias("within"),
        )
    )
    dealt = tiles.repartition("no", "lo", "hi").sortWithinPartitions("no", "lo", "hi")
    found = common.materialise(dealt.mapInArrow(_tiles(threshold), "node long, links long, root long"), "tiles")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    member = components(found, "node", "root")
    info = common.materialise(classes.join(links, "node", "left").join(member, "node", "left"), "linked")
    named = info.select("label", "embedding", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    joined = good.join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_vectors(common.table(spark, sf_dir, "embeddings"))
