"""Operator 7, media columns: content-defined payload chunking.

A payload is stored as a grey image of 8-bit samples (binary PGM).  Rolling gear
hashes cut the stored bytes into chunks, chunk digests meet in Spark joins, and each
distinct shared chunk is kept once.  A pack row per document holds its ordered chunk
list, with the bytes of chunks that nothing else holds; the chunk table holds the
rest.  Reading follows the list, joins the chunk table where it must, and verifies
the digest of every reassembled medium before its payload is used.

Whether a digest is shared is known from counts over all chunks.  The writing pass
asks a fixed-size bit filter over the shared digests, so no document's bytes are
shuffled to learn that its chunks are its own; a chunk that passes the filter by
chance is put into the chunk table too.

Defined cases: a null or empty text is one padded block of bytes 255; a null id stays
null; repeated rows share all their chunks; extra columns are ignored; an empty
table gives no rows.  A medium that does not verify raises an error.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm import bloom, common

BLOCK, PAD = 576, 255
LEAST, MOST, MASK_BITS = 512, 16384, 11


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    short = -len(raw) % BLOCK if raw else BLOCK
    return len(raw), raw + bytes([PAD]) * short


def to_media(data: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (BLOCK, len(data) // BLOCK) + data


def from_media(stored: bytes) -> bytes:
    kind, shape, top, data = stored.split(b"\n", 3)
    width, height = map(int, shape.split())
    if kind != b"P5" or top != b"255" or len(data) != width * height:
        raise ValueError("not a binary 8-bit PGM")
    return data


def gear_table(seed: int = 7) -> np.ndarray:
    """256 mixed numbers, by the splitmix64 rule."""
    x = (np.arange(1, 257, dtype=np.uint64) + np.uint64(seed << 10)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


_GEAR = gear_table()


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks.  The 32-bit gear hash at i is the sum of the last 32 gear
    numbers, each shifted by its age; doubling spans gives it for all i at once."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for span in (1, 2, 4, 8, 16):
        older = h[:-span] << np.uint32(span)
        h = h.copy()
        h[span:] += older
    marks = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    out, at, n = [], 0, len(data)
    while at < n:
        k = int(np.searchsorted(marks, at + LEAST))
        at = min(int(marks[k]) if k < len(marks) else n, at + MOST, n)
        out.append(at)
    return out


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of the chunks in order."""
    ends = cuts(data)
    return [(hashlib.sha256(c).digest(), c) for c in (data[a:b] for a, b in zip([0, *ends], ends))]


def _key(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(np.uint64)


def _feature(data: bytes) -> str:
    x = np.frombuffer(data, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    some = share[share > 0]
    return f"rows={len(x) // BLOCK};mean={x.mean():.6f};std={x.std():.6f};entropy={-(some * np.log2(some)).sum() + 0.0:.6f}"


_PACK = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_sha", pa.binary()), ("whole", pa.bool_()),
    ("recipe", pa.list_(pa.struct([("digest", pa.binary()), ("data", pa.binary())]))),
])
PACK_SCHEMA = "row long, doc_id long, n_bytes long, media_sha binary, whole boolean, recipe array<struct<digest:binary,data:binary>>"


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Writes ``docs`` (doc_id, text): the packs and the chunk table (digest, data)."""
    spark = docs.sparkSession
    common.ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def digests(batches):
        for batch in batches:
            found = [d for t in batch.column(0).to_pylist() for d, _ in chunks(to_media(payload(t)[1]))]
            yield pa.record_batch([pa.array(found, pa.binary())], ["digest"])

    shared = docs.select("text").mapInArrow(digests, "digest binary").groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    key = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    sent = spark.sparkContext.broadcast(bloom.build(shared, key))

    def packs(batches):
        bits, row = sent.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[] for _ in _PACK]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, data = payload(text)
                stored = to_media(data)
                parts = chunks(stored)
                apart = bloom.may_hold(bits, _key([d for d, _ in parts]))
                recipe = [{"digest": d, "data": None if away else c} for (d, c), away in zip(parts, apart)]
                for column, value in zip(out, (row, doc_id, n, hashlib.sha256(stored).digest(), not apart.any(), recipe)):
                    column.append(value)
                row += 1
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, _PACK)], schema=_PACK)

    def apart(batches):
        bits = sent.value
        for batch in batches:
            found: dict[bytes, bytes] = {}
            for text in batch.column(0).to_pylist():
                parts = chunks(to_media(payload(text)[1]))
                found.update(p for p, away in zip(parts, bloom.may_hold(bits, _key([d for d, _ in parts]))) if away)
            yield pa.record_batch([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["digest", "data"])

    once = docs.select("text").mapInArrow(apart, "digest binary, data binary").groupBy("digest").agg(F.first("data").alias("data"))
    return common.materialise(docs.mapInArrow(packs, PACK_SCHEMA), "packs"), common.materialise(once, "chunks")


def read(packs: DataFrame, table: DataFrame) -> DataFrame:
    """Per pack: doc_id, n_bytes, media (binary), reassembled and verified."""
    parts = packs.where("not whole").select("row", "doc_id", "n_bytes", "media_sha", F.posexplode("recipe").alias("i", "part"))
    refs = parts.select("row", "doc_id", "n_bytes", "media_sha", "i", F.col("part.digest").alias("digest"), F.col("part.data").alias("own"))
    own = refs.where("own is not null").drop("digest")
    away = refs.where("own is null").drop("own").join(table, "digest").select("row", "doc_id", "n_bytes", "media_sha", "i", F.col("data").alias("own"))
    gathered = own.unionAll(away).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.first("media_sha").alias("media_sha"), F.array_sort(F.collect_list(F.struct("i", "own"))).alias("parts"))
    joined = gathered.select("doc_id", "n_bytes", "media_sha", F.col("parts.own").alias("parts"))
    return packs.where("whole").select("doc_id", "n_bytes", "media_sha", F.col("recipe.data").alias("parts")).unionAll(joined)


FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches):
    names = [f.split()[0] for f in FEATURE_SCHEMA.split(", ")]
    for batch in batches:
        out = []
        for doc_id, n, sha, parts in zip(*(batch.column(i).to_pylist() for i in range(4))):
            stored = b"".join(parts)
            digest = hashlib.sha256(stored)
            if digest.digest() != sha:
                raise ValueError(f"the medium of document {doc_id} does not verify")
            data = from_media(stored)
            out.append((doc_id, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(stored), digest.hexdigest(), _feature(data)))
        columns = list(zip(*out)) if out else [()] * len(names)
        types = [pa.string() if n in ("payload_sha256", "media_sha256", "feature") else pa.int64() for n in names]
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types)], names)


def media_features(docs: DataFrame) -> DataFrame:
    packs, table = store(docs)
    return read(packs, table).mapInArrow(_features, FEATURE_SCHEMA)


def op7_media(spark, sf_dir: str) -> DataFrame:
    return media_features(common.table(spark, sf_dir, "documents"))
