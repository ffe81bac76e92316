"""Operator 10, suffix-array dedup: a logarithmic index family over long matches.

A byte goes if a window of 400 bytes that covers it starts anywhere else too.  Words
inside a window of 51 words that starts anywhere else too are counted beside it and
stay: passages of over fifty words that are shorter than 400 bytes show there.

Every window has one minimiser: the least hash among the short strings in it.  Equal
windows have equal minimisers, so only windows of one minimiser can match.  A run of
windows with one minimiser in a document is a context.  Counts over all documents tell
which minimisers occur twice; a bit filter, sized by their number, hands them to a
second reading of the documents, which writes the contexts of those (and, by chance, of
a few more, which then match nothing).

Minimisers are dealt into shards of about ``SHARD_BYTES`` of contexts, whose number
grows with the input.  A task takes a shard's contexts as they arrive, in batches of
``BATCH_BYTES``; each batch gets a suffix array, is scanned against the levels of the
shard's index family and joins them (``suffix_index``).

Equal contexts are one entry, with its number of rows.  A minimiser with more than
``LIMIT`` different contexts could outgrow a task: its windows are counted by 128-bit
digests in an ordinary aggregation instead, which is exact for them too.

Defined cases: a null or empty text, or one shorter than the window, loses nothing;
a null id stays null; repeated rows lose everything if they are long enough; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm import bloom, common
from confluo.llm import suffix_index as X

LIMIT = 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)
BATCH_BYTES, SHARD_BYTES = 1 << 19, 4 << 20
_ROWS = 500


def _slices(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            yield whole.slice(at, _ROWS)


def _keys(batches):
    """The minimisers of the texts, each as often as it heads a run of windows."""
    for batch in _slices(batches):
        raws = [(t or "").encode() for t in batch.column(0).to_pylist()]
        found = [key for _, _, key, _, _ in X.scan(raws)]
        yield pa.record_batch([pa.array(np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64))], ["key"])


_CONTEXT = pa.list_(pa.struct([("unit", pa.int8()), ("start", pa.int32()), ("size", pa.int32()), ("key", pa.int64()), ("at", pa.int64()), ("digest", pa.binary())]))
_ROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.string()), ("data", pa.binary()), ("contexts", _CONTEXT)])
ROW_SCHEMA = "row long, doc_id long, n_bytes long, sha string, data binary, contexts array<struct<unit:byte,start:int,size:int,key:long,at:long,digest:binary>>"


def _part(unit: X.Unit, raw: bytes, words: list[bytes], start: int, size: int) -> bytes:
    return raw[start : start + size] if unit is X.BYTES else b" ".join(words[start : start + size])


def _rows(sent):
    def run(batches):
        bits, row, at = sent.value, TaskContext.get().partitionId() << 40, TaskContext.get().partitionId() << 40
        for batch in _slices(batches):
            raws = [(t or "").encode() for t in batch.column(1).to_pylist()]
            some: list[list] = [[] for _ in raws]
            words: dict[int, list[bytes]] = {}
            for unit, text, key, first, end in X.scan(raws):
                hit = np.flatnonzero(bloom.may_hold(bits, key))
                for i, k, a, b in zip(*(c[hit].tolist() for c in (text, key.view(np.int64), first, end))):
                    size = b - a + unit.window - 1
                    if unit is X.WORDS and i not in words:
                        words[i] = raws[i].split()
                    digest = hashlib.md5(b"%d" % unit.number + _part(unit, raws[i], words.get(i, []), a, size)).digest()
                    some[i].append({"unit": unit.number, "start": a, "size": size, "key": k, "at": at, "digest": digest})
                    at += 1
            columns = [
                range(row, row + len(raws)), batch.column(0).to_pylist(), [len(r) for r in raws], [None if c else hashlib.sha256(r).hexdigest() for r, c in zip(raws, some)],
                [pa.compress(r, "zstd", asbytes=True) if c else None for r, c in zip(raws, some)], [c or None for c in some],
            ]
            row += len(raws)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _ROW)], schema=_ROW)

    return run


def _pieces(sent, routed, crowded: bool):
    """What those contexts of each row hold that the filter of wanted ones lets pass, of
    the minimisers that the filter of crowded ones lets pass, or of the others."""

    def run(batches):
        for batch in _slices(batches):
            some = batch.column(2).flatten()
            row = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy())
            at, key = (some.field(n).to_numpy() for n in ("at", "key"))
            hit = np.flatnonzero(bloom.may_hold(sent.value, _mixed(at)) & (bloom.may_hold(routed.value, key.view(np.uint64)) == crowded))
            out, raw, words, last = [], b"", [], -1
            picked = some.take(pa.array(hit))
            for i, number, start, size in zip(row[hit].tolist(), *(picked.field(n).to_pylist() for n in ("unit", "start", "size"))):
                if i != last:
                    raw, words, last = pa.decompress(batch.column(1)[i].as_py(), batch.column(0)[i].as_py(), "zstd", asbytes=True), [], i
                if number and not words:
                    words = raw.split()
                out.append(_part(X.UNITS[number], raw, words, start, size))
            yield pa.record_batch([picked.field("unit"), picked.field("key"), picked.field("digest"), pa.array(out, pa.binary())], ["unit", "key", "digest", "data"])

    return run


def _mixed(numbers: np.ndarray) -> np.ndarray:
    """Spreads the numbers of contexts over 64 bits."""
    h = numbers.astype(np.uint64) * _ODD
    return h ^ (h >> np.uint64(32))


def _mixed_numbers(batches):
    for batch in batches:
        yield pa.record_batch([pa.array(_mixed(batch.column(0).to_numpy()).view(np.int64))], ["key"])


_SPAN_TYPE = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
SPANS = "array<struct<s:int,e:int>>"


def _spans(unit: X.Unit, marks: np.ndarray) -> list[dict]:
    """Ranges of symbols covered by the marked window starts."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], marks.view(np.int8), [0]))))
    out: list[dict] = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if out and a <= out[-1]["e"]:
            out[-1]["e"] = b - 1 + unit.window
        else:
            out.append({"s": a, "e": b - 1 + unit.window})
    return out


def _match(batches):
    """Rows (unit, shard, digest, data) sorted by unit and shard, in the order in which
    they arrive.  Of equal contexts the first counts."""

    def found(unit: X.Unit, family: X.Family, parts: list, names: list[bytes]):
        if parts:
            family.add(parts)
        out = [(names[i], _spans(unit, m)) for i, m in family.found()]
        return pa.record_batch([pa.array([n for n, _ in out], pa.binary()), pa.array([s for _, s in out], _SPAN_TYPE)], ["digest", "spans"])

    family, parts, names, known, size, last = None, [], [], set(), 0, None
    for batch in batches:
        for number, shard, digest, data in zip(*(c.to_pylist() for c in batch.columns)):
            if (number, shard) != last:
                if family:
                    yield found(X.UNITS[last[0]], family, parts, names)
                family, parts, names, known, size, last = X.Family(X.UNITS[number]), [], [], set(), 0, (number, shard)
            if digest in known:
                continue
            known.add(digest)
            parts.append((len(names), X.UNITS[number].symbols(data)))
            names.append(digest)
            size += len(data)
            if size >= BATCH_BYTES:
                family.add(parts)
                parts, size = [], 0
    if family:
        yield found(X.UNITS[last[0]], family, parts, names)


def _windows(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            out: list[list] = [[], [], [], []]
            for number, digest, data in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                unit = X.UNITS[number]
                symbols = unit.symbols(data)
                n = len(symbols) - unit.window + 1
                out[0].append(pa.array([digest] * n, pa.binary()))
                out[1].append(pa.array(np.arange(n, dtype=np.int32)))
                for i in (0, 1):
                    out[2 + i].append(pa.array(X.window_digests(unit, symbols, i).view(np.int64)))
            yield pa.record_batch([pa.concat_arrays(c) for c in out], ["digest", "s", "h1", "h2"])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeated_words long, kept binary"


def _covered(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted ranges that neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or []):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _cut(batches):
    """Removes the ranges of bytes of each row, and counts its ranges of words."""
    for batch in batches:
        out = []
        for doc_id, n, data, spans, words in zip(*(c.to_pylist() for c in batch.columns)):
            data = pa.decompress(data, n, "zstd", asbytes=True)
            gone, at, kept = _covered(spans), 0, []
            for s, e in gone:
                kept.append(data[at:s])
                at = e
            kept = b"".join([*kept, data[at:]])
            out.append((doc_id, len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), sum(e - s for s, e in _covered(words)), kept))
        names = [f.split()[0] for f in RESULT.split(", ")]
        types = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.binary()]
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [()] * 7, types)], names)


def _sharded(contexts: DataFrame, held: dict[int, int]) -> DataFrame:
    """Rows in the order in which ``_match`` takes them.  The number of shards of a unit
    follows from ``held``, what its contexts hold in symbols."""
    # a word takes about eight bytes
    shards = [max(1, -(-held.get(u.number, 0) * (1 if u.span > 1 else 8) // SHARD_BYTES)) for u in X.UNITS]
    shard = F.when(F.col("unit") == 0, F.pmod("key", F.lit(shards[0]))).otherwise(F.pmod("key", F.lit(shards[1]))).alias("shard")
    return contexts.select("unit", shard, "digest", "data").repartition(sum(shards), "unit", "shard").sortWithinPartitions("unit", "shard")


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans).  rows: every document once, with its bytes (compressed) only if
    some of its windows may repeat; spans: row, spans (arrays of s, e) of the repeated bytes and
    words."""
    spark = docs.sparkSession
    common.ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    twice = docs.select("text").mapInArrow(_keys, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    twice = common.materialise(twice.select("key"), "twice")
    sent = spark.sparkContext.broadcast(bloom.build(twice, F.col("key"), bloom.bits_for(twice.count())))
    table = common.materialise(docs.mapInArrow(_rows(sent), ROW_SCHEMA), "rows")
    held = table.where("contexts is not null")
    seen = held.select("row", F.explode("contexts").alias("c")).select("row", "c.*")
    different = seen.groupBy("key", "digest").agg(F.count("*").alias("n"), F.min("at").alias("at"), F.max("unit").alias("unit"), F.max("size").alias("size"))
    different = common.materialise(different, "contexts")
    # a context that is alone in its minimiser can match nothing but its own copies
    keys = common.materialise(different.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "keys")
    wanted = common.materialise(different.join(keys, "key").select("at", "unit", "size", (F.col("m") > LIMIT).alias("crowded")), "wanted")
    total = {(r["unit"], r["crowded"]): r["b"] for r in wanted.groupBy("unit", "crowded").agg(F.sum("size").alias("b")).collect()}
    want = spark.sparkContext.broadcast(bloom.build(wanted.select("at").mapInArrow(_mixed_numbers, "key long"), F.col("key"), bloom.bits_for(wanted.count())))
    # all contexts of a minimiser take one way, a few of those of uncrowded ones the long one
    route = spark.sparkContext.broadcast(bloom.build(keys.where(F.col("m") > LIMIT), F.col("key")))
    pieces = lambda crowded: held.select("n_bytes", "data", "contexts").mapInArrow(_pieces(want, route, crowded), "unit byte, key long, digest binary, data binary")
    found = _sharded(pieces(False), {u: b for (u, crowded), b in total.items() if not crowded}).mapInArrow(_match, f"digest binary, spans {SPANS}")
    if any(crowded for _, crowded in total):
        windows = pieces(True).select("unit", "digest", "data").mapInArrow(_windows, "digest binary, s int, h1 long, h2 long")
        windows = common.materialise(windows.withColumn("place", F.xxhash64("digest", "s")), "windows")
        # the filter may let a context pass twice, so places are compared, not counted
        again = windows.groupBy("h1", "h2").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a < b").select("h1", "h2")
        again = common.materialise(again, "again")
        windows = windows.join(again, ["h1", "h2"]).groupBy("digest").agg(F.collect_set("s").alias("at"))
        size = F.when(F.col("unit") == 0, X.BYTES.window).otherwise(X.WORDS.window)
        windows = windows.join(different.select("digest", size.alias("size")), "digest")
        found = found.unionAll(windows.select("digest", F.transform("at", lambda s: F.struct(s.alias("s"), (s + F.col("size")).alias("e")))))
    # a context that occurs again as a whole is repeated throughout
    found = found.unionAll(different.where("n > 1").select("digest", F.array(F.struct(F.lit(0).alias("s"), F.col("size").alias("e")))))
    found = common.materialise(found.groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans")), "matches")
    shifted = F.transform("spans", lambda x: F.struct((x["s"] + F.col("start")).alias("s"), (x["e"] + F.col("start")).alias("e")))
    placed = seen.select("row", "unit", "start", "digest").join(found, "digest").select("row", "unit", shifted.alias("spans"))
    of = lambda n: F.flatten(F.collect_list(F.when(F.col("unit") == n, F.col("spans"))))
    return table, placed.groupBy("row").agg(of(0).alias("spans"), of(1).alias("words"))


def dedup(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    repeated_words (words in a passage of over fifty words that starts anywhere else
    too) and the bytes kept (null where no context is shared)."""
    table, spans = repeated_spans(docs)
    none = F.lit(0).cast("long")
    whole = table.where("contexts is null").select("doc_id", "n_bytes", none, none, "sha", none, F.lit(None).cast("binary"))
    cut = table.where("contexts is not null").select("row", "doc_id", "n_bytes", "data").join(spans, "row", "left").select("doc_id", "n_bytes", "data", "spans", "words").mapInArrow(_cut, RESULT)
    return cut.unionAll(whole)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents")).drop("kept")
