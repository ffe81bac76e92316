"""Operator 5, packing: sum-of-squares online placement into token windows.

Every task streams its documents once.  Whole windows are cut off a document; the
remainder goes to the fill level that leaves the least sum of squared counts of
partially filled windows, those counts being kept in an array by level.  When the
stream ends, the windows that are still open are emptied into as few as possible,
cutting pieces where needed, so that a task leaves one padded window at most.

Memory is bounded by the open windows of one task: at most one piece list of
``capacity`` tokens for each.  A restarted task reads the same rows in the same
order and gives the same sequences.

Defined cases: a null or empty text is the end identifier alone; a null id stays
null; repeated rows are packed row by row; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm import bpe, common
from confluo.llm.token_counts import default_vocabulary

CAPACITY = 1024
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_NEVER = np.iinfo(np.int64).max


class SumOfSquares:
    """Chooses the window for a piece; ``count[h]`` windows are filled to level h."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(capacity + 1)]

    def level(self, size: int) -> int:
        """The level to fill up, 0 for a new window; ties go to the fullest."""
        c, room = self.count, self.capacity - size
        best, least = 0, (2 * c[size] + 1 if size < self.capacity else 0)
        if room > 0:
            here = c[1 : room + 1]
            change = np.where(here > 0, 2 * (c[1 + size : room + 1 + size] - here) + 2, _NEVER)
            if here[-1] > 0:
                change[-1] = 1 - 2 * here[-1]
            at = room - 1 - int(np.argmin(change[::-1]))
            if change[at] <= least:
                best = at + 1
        return best

    def place(self, size: int, piece) -> list | None:
        """Put the piece in; gives the window's pieces if it is full now."""
        h = self.level(size)
        window = []
        if h:
            window = self.open[h].pop()
            self.count[h] -= 1
        window.append(piece)
        if h + size == self.capacity:
            return window
        self.open[h + size].append(window)
        self.count[h + size] += 1
        return None

    def drain(self):
        """The windows still open, fullest first."""
        for h in range(self.capacity - 1, 0, -1):
            yield from self.open[h]
            self.open[h] = []
        self.count[:] = 0


def pack_stream(documents, capacity: int = CAPACITY):
    """documents: (row, ids as little-endian u4 bytes).  Yields windows, each a list
    of (row, start, ids bytes, document's tokens)."""
    packer, step = SumOfSquares(capacity), 4 * capacity
    for row, ids in documents:
        total = len(ids) // 4
        whole = len(ids) // step * step
        for at in range(0, whole, step):
            yield [(row, at // 4, ids[at : at + step], total)]
        if whole < len(ids):
            full = packer.place(total - whole // 4, (row, whole // 4, ids[whole:], total))
            if full:
                yield full
    window, room = [], step
    for piece in (p for w in packer.drain() for p in w):
        row, start, ids, total = piece
        while ids:
            window.append((row, start, ids[:room], total))
            taken = min(room, len(ids))
            ids, start, room = ids[taken:], start + taken // 4, room - taken
            if not room:
                yield window
                window, room = [], step
    if window:
        yield window


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their identifiers.  No shuffle; a
    sequence holds pieces of one task's documents only."""
    common.ship(docs.sparkSession)
    default, pattern = default_vocabulary()
    path, ranks = vocabulary or default, ranks or default_ranks()

    def run(batches):
        encoder = bpe.kept(bpe.IdEncoder, path, pattern, ranks)
        end = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40

        def documents():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    yield doc_id, encoder.encode(text or "") + end

        out: list[tuple] = []
        for window in pack_stream(documents(), capacity):
            offset = 0
            for doc_id, start, ids, total in window:
                out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, ids))
                offset += len(ids) // 4
            sequence += 1
            if len(out) >= 2000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.lean(run), PIECE_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in PIECE_SCHEMA.split(", ")]
    return pa.record_batch([pa.array(list(c), pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*rows))], names)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents")).drop("ids")
