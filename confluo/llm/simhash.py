"""Operator 9, SimHash near-duplicates: byte-position inverted index, count filter.

A fingerprint has eight positional bytes.  Two fingerprints that differ in at most
four bits share at least four of them.  A posting is keyed by three positional bytes
from a fixed family of twenty triples in which every four positions contain a whole
triple, so each such pair meets in at least one posting list.  Inside a list the
shared bytes of each pair are tallied, pairs below four are dropped and the rest are
verified on all 64 bits.

Equal fingerprints are one entry of the index.  Lists longer than ``TILE`` are dealt
into pairs of blocks, so no task holds a list whole and no pair is skipped; a tile
hands on a spanning forest of its links and never the pairs.

The pipeline keeps one document of each component (``keep_one``).  Its links are those
of the fingerprints and, since texts whose five-word shingles have a Jaccard similarity
of 0.8 differ in ten bits of 64 on average and no byte index covers that, those of 0.8
or more as well: bands of least hashes propose groups, and every pair inside a group is
checked on its shingles.

Defined cases: a null or empty text has fingerprint zero, linked like any other; a
null id is kept in the result but cannot name a component; repeated rows share a
component; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.llm import bloom, common
from confluo.llm.graph import components
from confluo.llm.suffix_index import words as word_codes

MAX_BITS = 4
MIN_SHARED = 8 - MAX_BITS
TILE = 512
#: Of ``keep_one``: words of a shingle, least Jaccard similarity; bands of least hashes
#: and hashes in each, so that a pair at 0.8 shares no band with probability
#: (1 - 0.8 ** 5) ** 40, about 1.3e-7; sets of a block.
WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS, BLOCK, BLOCK_SHINGLES = 40, 5, 256, 1 << 20


def position_triples() -> list[tuple[int, int, int]]:
    """Triples of the positions 0-7 such that any four positions contain one: the
    positions fall into three classes; a triple lies in one class, or has two
    positions in a class and one in the next."""
    classes = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [c for c in classes if len(c) == 3]
    for i, c in enumerate(classes):
        out += [(a, b, x) for a, b in combinations(c, 2) for x in classes[(i + 1) % 3]]
    return out


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    tokens = (text or "").encode().lower().split()
    n = len(tokens) - words + 1
    if not tokens:
        return 0
    whole = b" ".join(tokens)
    if n <= 1:
        return xxhash.xxh64_intdigest(whole, seed)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    h = xxhash.xxh64_intdigest
    values = np.array([h(whole[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())], "<u8")
    counts = np.add.reduce(np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) per row; fp is the fingerprint's 64 bits as a signed long."""
    common.ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.lean(run), "doc_id long, fp long")


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Boolean matrix of the pairs of a and b that pass the tally and the check."""
    shared = np.zeros((len(a), len(b)), np.uint8)
    ab, bb = a.view(np.uint8).reshape(-1, 8), b.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        shared += ab[:, k, None] == bb[None, :, k]
    at = np.nonzero(shared >= MIN_SHARED)
    near = np.bitwise_count(a[at[0]] ^ b[at[1]]) <= MAX_BITS
    out = np.zeros(shared.shape, bool)
    out[at[0][near], at[1][near]] = True
    return out


def forest(values: np.ndarray, links: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each entry to the smallest entry of its component in the tile."""
    order = np.arange(len(values))
    root = order.copy()
    while True:
        lowest = np.where(links, root[None, :], len(values)).min(axis=1, initial=len(values))
        after = np.minimum(root, lowest)
        after = after[after]
        if np.array_equal(after, root):
            break
        root = after
    return [(int(values[i]), int(values[r])) for i, r in enumerate(root) if i != r]


def _tile_edges(batches):
    """Rows come sorted by list and tile; side tells a tile's two blocks apart."""
    held: list[pa.RecordBatch] = []

    def flush(keys, fps):
        cut = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        out = []
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(fps)]):
            if hi - lo > 1:
                part = np.unique(fps[lo:hi])
                out += forest(part.view(np.int64), linked(part, part))
        u, v = zip(*out) if out else ((), ())
        return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    keys = fps = None
    for batch in batches:
        k = np.column_stack([batch.column(i).to_numpy() for i in range(4)])
        f = batch.column(4).to_numpy().astype(np.int64).view(np.uint64)
        keys, fps = (k, f) if keys is None else (np.concatenate([keys, k]), np.concatenate([fps, f]))
        if not len(fps):
            continue
        last = int(np.flatnonzero(np.any(keys != keys[-1], axis=1))[-1]) + 1 if np.any(keys != keys[-1]) else 0
        if last:
            yield flush(keys[:last], fps[:last])
            keys, fps = keys[last:], fps[last:]
    if fps is not None and len(fps):
        yield flush(keys, fps)


def near_edges(fps: DataFrame) -> DataFrame:
    """(u, v) links that connect every two distinct values of ``fps.fp`` within
    ``MAX_BITS`` bits; ``fps`` holds each value once."""
    common.ship(fps.sparkSession)
    masks = [sum(0xFF << 8 * p for p in t) for t in position_triples()]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    parts: list[Column] = [F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed]
    postings = fps.select("fp", F.posexplode(F.array(*parts)).alias("triple", "bytes"))
    sizes = common.materialise(postings.groupBy("triple", "bytes").agg(F.count("*").alias("size")).where("size > 1"), "lists")
    key = F.xxhash64("triple", "bytes")
    sent = fps.sparkSession.sparkContext.broadcast(bloom.build(sizes.select(key.alias("key")), F.col("key")))
    blocks = F.ceil(F.col("size") / TILE).cast("long")
    tiles = (
        bloom.passing(postings, key, sent).join(sizes, ["triple", "bytes"])
        .withColumn("block", F.pmod(F.xxhash64("fp"), blocks))
        .select("triple", "bytes", "block", "fp", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
        .select(F.col("triple").cast("long").alias("triple"), "bytes", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "fp")
    )
    dealt = tiles.repartition("triple", "bytes", "lo", "hi").sortWithinPartitions("triple", "bytes", "lo", "hi")
    return dealt.mapInArrow(common.lean(_tile_edges), "u long, v long")


def _classes(rows: DataFrame) -> DataFrame:
    """rows (doc_id, fp): per fingerprint its component_id, the least doc_id of the
    component (null if no row of it has an id)."""
    classes = common.materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    found = components(near_edges(classes.select("fp"))).withColumnRenamed("node", "fp")
    member = common.materialise(classes.join(found, "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component")), "members")
    lowest = common.materialise(member.groupBy("component").agg(F.min("first_id").alias("component_id")), "lowest")
    return common.materialise(member.join(lowest, "component").select("fp", "component_id"), "named")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    rows = common.materialise(fingerprints(docs), "fingerprints")
    return rows.join(_classes(rows), "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of a text; a shorter text is one
    shingle, a text without words has none."""
    codes = word_codes(np.frombuffer((text or "").encode().lower(), np.uint8))[1]
    if not len(codes):
        return codes
    n = max(len(codes) - words + 1, 1)
    h = np.full(n, min(words, len(codes)), np.uint64)
    for k in range(min(words, len(codes))):
        h = (h ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


_FACTORS = np.random.default_rng(42).integers(0, 1 << 31, (2, BANDS * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key per band: a hash of the band's number and its least hashes."""
    if not len(found):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    halves = found.astype("<u8").view("<u4").reshape(-1, 2)
    for at in range(0, len(found), 512):
        part = halves[at : at + 512, 0] * _FACTORS[0]
        part += halves[at : at + 512, 1] * _FACTORS[1]
        np.minimum(low, part.min(axis=1), out=low)
    return np.array([xxhash.xxh3_64_intdigest(r.tobytes(), i) for i, r in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


_SIGNATURE = pa.schema([("doc_id", pa.int64()), ("print", pa.int64()), ("fp", pa.int64()), ("set", pa.int64()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _signatures(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            texts = batch.column(2).to_pylist()
            sets = [shingles(t) for t in texts]
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            bands = pa.array([band_keys(x) for x in sets], pa.list_(pa.int64()))
            names = signed([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets])
            yield pa.record_batch([batch.column(0), batch.column(1), signed([fingerprint(t) for t in texts]), names, pa.array([len(x) for x in sets], pa.int64()), bands], schema=_SIGNATURE)


def similar(sets: list[np.ndarray], least: float = SIMILARITY) -> np.ndarray:
    """Boolean matrix of the pairs of sets whose Jaccard similarity is at least ``least``."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    first = np.cumsum(count) - count
    members = owner[np.argsort(place, kind="stable")]
    out, at = np.zeros((len(sets), len(sets)), bool), np.cumsum(sizes) - sizes
    for i, n in enumerate(sizes):
        mine = place[at[i] : at[i] + n]
        mine = mine[count[mine] > 1]
        widths = count[mine]
        hit = np.repeat(first[mine] - np.cumsum(widths) + widths, widths) + np.arange(widths.sum())
        shared = np.bincount(members[hit], minlength=len(sets))
        out[i] = shared >= least * (n + sizes - shared) - 1e-9
    return out


def _similar_edges(batches):
    """Rows (group, lo, hi, set, text) sorted by the first three."""
    names: dict[int, str] = {}
    last = None

    def flush():
        if len(names) < 2:
            return None
        keys = sorted(names)
        found = forest(np.array(keys, np.int64), similar([shingles(names[k]) for k in keys]))
        u, v = zip(*found) if found else ((), ())
        return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        for *key, name, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if key != last:
                if (out := flush()) is not None:
                    yield out
                names, last = {}, key
            names[name] = text
    if (out := flush()) is not None:
        yield out


def similar_edges(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v) links that connect the sets of ``classes`` (set, print, size, bands) at
    ``SIMILARITY`` or more.  Sets with a band in common fall into one group; inside a
    group, dealt into pairs of blocks of about ``BLOCK`` sets and at most about
    ``BLOCK_SHINGLES`` shingles, every pair is compared on its shingles."""
    postings = classes.select("set", F.explode("bands").alias("key"))
    lists = postings.groupBy("key").agg(F.count("*").alias("size"), F.min("set").alias("head")).where("size > 1").select("key", "head")
    lists = common.materialise(lists, "bands")
    sent = docs.sparkSession.sparkContext.broadcast(bloom.build(lists, F.col("key")))
    shared = bloom.passing(postings, F.col("key"), sent).join(lists, "key")
    grouped = common.materialise(components(shared.select("set", "head"), "set", "head").toDF("set", "group"), "groups")
    blocks = F.greatest(F.ceil(F.col("total") / BLOCK_SHINGLES), F.ceil(F.col("sets") / BLOCK)).cast("long")
    sized = common.materialise(grouped.join(classes.select("set", "print", "size"), "set"), "sized")
    total = sized.groupBy("group").agg(F.sum("size").alias("total"), F.count("*").alias("sets"))
    placed = common.materialise(sized.join(total, "group").withColumn("block", F.pmod(F.xxhash64("set"), blocks)), "placed")
    text = docs.select(F.xxhash64(F.col("text").cast("string")).alias("print"), F.col("text").cast("string").alias("text"))
    wanted = placed.select("print").distinct()
    held = docs.sparkSession.sparkContext.broadcast(bloom.build(wanted, F.col("print")))
    texts = bloom.passing(text, F.col("print"), held).join(wanted, "print", "left_semi").groupBy("print").agg(F.first("text").alias("text"))
    tiles = (
        placed.join(texts, "print")
        .select("group", "block", "set", "text", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
        .select("group", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "set", "text")
    )
    dealt = tiles.repartition("group", "lo", "hi").sortWithinPartitions("group", "lo", "hi")
    return dealt.mapInArrow(common.lean(_similar_edges), "u long, v long")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``, the one with the least id (one without an
    id only where no row of the component has one); all columns.  Rows are told apart by
    id and text, so clashing ids do no harm.  Texts stay where they are, but for those of
    rows that go, or stand there twice, and of a few more that the filter of bits cannot
    tell from them."""
    spark = docs.sparkSession
    common.ship(spark)
    text, own = F.col("text").cast("string"), F.col("doc_id").cast("long")
    sent = docs.select(own.alias("doc_id"), F.xxhash64(text).alias("print"), text.alias("text"))
    rows = common.materialise(sent.mapInArrow(common.lean(_signatures), "doc_id long, print long, fp long, set long, size long, bands array<long>"), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "print")
    classes = rows.groupBy("set").agg(F.min(order).alias("least"), F.min("print").alias("print"), F.max("size").alias("size"), F.first("bands").alias("bands"))
    classes = common.materialise(classes, "sets")
    prints = common.materialise(rows.groupBy("fp").agg(F.min("set").alias("head")), "heads")
    near = near_edges(prints.select("fp"))
    head = lambda side: prints.select(F.col("fp").alias(side), F.col("head").alias(f"{side}_set"))
    near = near.join(head("u"), "u").join(head("v"), "v").select("u_set", "v_set")
    alike = rows.select("fp", "set").distinct().join(prints, "fp").where("set <> head").select("set", "head")
    edges = common.materialise(similar_edges(docs, classes).unionAll(near).unionAll(alike), "similar")
    member = classes.select("set", "least").join(components(edges).toDF("set", "component"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    first = member.groupBy("component").agg(F.min("least").alias("least")).select("least.doc_id", "least.print", F.lit(True).alias("first"))
    seen = rows.groupBy("doc_id", "print").agg(F.count("*").alias("n"))
    same = F.col("s.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("s.print") == F.col("f.print"))
    listed = seen.alias("s").join(first.alias("f"), same, "left").select("s.doc_id", "s.print", "n", F.coalesce("first", F.lit(False)).alias("first"))
    listed = common.materialise(listed.where("n > 1 or not first").select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"), "first"), "listed")
    bits = spark.sparkContext.broadcast(bloom.build(listed.select(F.xxhash64("_id", "_print").alias("key")), F.col("key")))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # no name of the caller's clashes
    own, text = (F.col(f"c{docs.columns.index(c)}").cast(t) for c, t in (("doc_id", "long"), ("text", "string")))
    key = F.xxhash64(own, F.xxhash64(text))
    place = own.eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_print"))
    doubtful = bloom.passing(plain, key, bits).join(listed, place, "left").where(F.coalesce("first", F.lit(True)))
    once = doubtful.where("first").dropDuplicates(["_id", "_print"])
    return bloom.passing(plain, key, bits, hit=False).unionAll(doubtful.where("first is null").unionAll(once).select(*plain.columns)).toDF(*docs.columns)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
