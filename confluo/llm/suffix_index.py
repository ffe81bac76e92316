"""A logarithmic family of suffix arrays that reports long matches.

Texts are sequences of symbols: bytes, or words by their 64-bit hashes.  What is
indexed are the windows of a fixed number of symbols, sorted as the suffixes that
start there.  A new batch is sorted by itself and scanned against every level there is;
windows that occur again are marked on both sides.  Then, while the last level is no
larger than the batch, the two sorted orders are merged into one level of both, so
there are at most as many levels as the number of batches has binary digits, and no
window is sorted twice.

Two suffixes are compared by the hashes of their prefixes: the longest common prefix
is found by halving, then one symbol decides.  Hashes have 64 bits, so two different
windows pass for equal with a probability of about 5e-20 for each comparison.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASES = (np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5))
_BYTE = np.sort(np.random.default_rng(42).integers(1, 1 << 63, 256, np.uint64))


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words of a text, and a hash of each, from its bytes."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = (data == 32) | (data - np.uint8(9) < 5)
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, size = edge[::2], edge[1::2] - edge[::2]
    loads = np.ndarray((len(data) + 1,), "<u8", np.append(data, np.zeros(8, np.uint8)).tobytes(), 0, (1,))
    code, some, at = size.astype(np.uint64) * _ONE, np.arange(len(size)), 0
    while len(some):
        code[some] ^= loads[start[some] + at] & _MASK[np.minimum(size[some] - at, 8)]
        code[some] *= _TWO
        code[some] ^= code[some] >> np.uint64(32)
        at += 8
        some = some[size[some] > at]
    return start, code


@dataclass(frozen=True)
class Unit:
    """Symbols of a kind, the window's length and that of the strings among which a
    window's minimiser is chosen.  ``span`` symbols fit into one load."""

    number: int
    window: int
    gram: int
    span: int

    def symbols(self, raw: bytes) -> np.ndarray:
        data = np.frombuffer(raw, np.uint8)
        return data if self.span > 1 else words(data)[1]

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        return _BYTE[symbols] if self.span > 1 else symbols

    def loads(self, symbols: np.ndarray) -> np.ndarray:
        """``span`` symbols from each position as a number, in the order of symbols."""
        if self.span == 1:
            return symbols
        return np.ndarray((max(len(symbols) - 7, 0),), ">u8", symbols.tobytes(), 0, (1,)).astype(np.uint64)


BYTES = Unit(0, 400, 64, 8)
#: Passages of over fifty words.
WORDS = Unit(1, 51, 8, 1)
UNITS = (BYTES, WORDS)


def grams(unit: Unit, symbols: np.ndarray) -> np.ndarray:
    """A hash of the ``gram`` symbols from each position."""
    factor = _ONE + np.uint64(2 * unit.number)
    with np.errstate(over="ignore"):
        h, span = unit.loads(symbols) * factor, unit.span
        h ^= h >> np.uint64(31)
        while span < unit.gram:
            h = h[:-span] * factor + h[span:]
            factor, span = factor * factor + np.uint64(2), span * 2
        h ^= h >> np.uint64(32)
        h *= _TWO
        h ^= h >> np.uint64(29)
    return h


def contexts(unit: Unit, symbols: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows whose minimiser is the same string at the same place, the first
    of the least ones, in the texts that stand in ``symbols`` from ``at``: number of the
    text, key, first start and end (exclusive) in the text.  Equal windows have equal
    keys, and no two windows of one run are equal."""
    long = np.flatnonzero(size >= unit.window)
    if not len(long):
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    h = grams(unit, symbols)
    width, span = unit.window - unit.gram + 1, 1
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    while span * 2 <= width:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    rest = width - span
    low = np.minimum(low[: len(low) - rest], low[rest:])
    begin, end = at[long], at[long] + size[long] - unit.window + 1
    bounds = np.unique(np.concatenate((np.flatnonzero(low[1:] != low[:-1]) + 1, begin, end)))
    first, last = bounds[:-1], bounds[1:]
    text = np.searchsorted(begin, first, "right") - 1
    inside = (text >= 0) & (first < end[text])
    first, last, text = first[inside], last[inside], text[inside]
    return long[text], h[(low[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)], first - begin[text], last - begin[text]


def scan(raws: list[bytes], size: int = 1 << 16):
    """Contexts of many texts, computed for about ``size`` bytes of them at a time:
    unit, numbers of the texts, keys, first starts, ends."""
    low = held = 0
    for high in range(1, len(raws) + 1):
        held += len(raws[high - 1])
        if held >= size or high == len(raws):
            lengths = np.array([len(r) for r in raws[low:high]])
            at = np.cumsum(lengths + 1) - lengths - 1
            data = np.frombuffer(b" ".join(raws[low:high]), np.uint8)
            text, *rest = contexts(BYTES, data, at, lengths)
            yield (BYTES, text + low, *rest)
            start, codes = words(data)
            edge = np.searchsorted(start, np.append(at, len(data) + 1))
            text, *rest = contexts(WORDS, codes, edge[:-1], np.diff(edge))
            yield (WORDS, text + low, *rest)
            low, held = high, 0


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = [_powers(b, 512) for b in _BASES]


def prefixes(codes: np.ndarray, base: int = 0) -> np.ndarray:
    """h[i + 1] = h[i] * base + codes[i], modulo 2 ** 64, from h[0] = 0."""
    b = int(_BASES[base])
    scaled = codes * _powers(np.uint64(pow(b, -1, 1 << 64)), len(codes))[1:]
    return np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(scaled))) * _powers(np.uint64(b), len(codes))


def window_digests(unit: Unit, symbols: np.ndarray, base: int) -> np.ndarray:
    h = prefixes(unit.codes(symbols), base)
    return h[unit.window :] - h[: len(h) - unit.window] * _POWER[base][unit.window]


def _refine(unit: Unit, symbols: np.ndarray, place: np.ndarray, first: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Sorts the windows at ``place`` by load after load, going on with those that are
    tied with a different window."""
    order = np.argsort(first)
    key = first[order]
    changes = np.concatenate(([True], key[1:] != key[:-1]))
    group = np.flatnonzero(changes)[np.cumsum(changes) - 1]
    at, depth = np.arange(len(order)), unit.span
    loads = unit.loads(symbols)
    while depth < unit.window and len(at):
        mixed = np.zeros(len(order) + 1, bool)
        mixed[group[at][digest[order[at]] != digest[order[group[at]]]]] = True
        at = at[mixed[group[at]]]
        if not len(at):
            break
        key = loads[place[order[at]] + depth]
        by = np.lexsort((key, group[at]))
        order[at], key = order[at[by]], key[by]
        own = group[at]
        changes = np.concatenate(([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])))
        group[at] = at[np.flatnonzero(changes)[np.cumsum(changes) - 1]]
        depth += unit.span
    return order


class Level:
    """The sorted windows of one or more batches of texts (number, symbols)."""

    def __init__(self, unit: Unit, parts: list[tuple[int, np.ndarray]]):
        self.unit, self.batches = unit, 1
        sizes = np.array([len(s) for _, s in parts])
        self.numbers, self.widths = np.array([n for n, _ in parts]), sizes - unit.window + 1
        self.offsets = np.cumsum(sizes) - sizes
        # one symbol more, so that prefix hashes and symbols have one length
        self.symbols = np.concatenate([s for _, s in parts] + [np.zeros(1, parts[0][1].dtype)])
        self.hashes = prefixes(unit.codes(self.symbols[:-1]))
        place = np.repeat(self.offsets - (np.cumsum(self.widths) - self.widths), self.widths) + np.arange(self.widths.sum())
        digest = self.hashes[place + unit.window] - self.hashes[place] * _POWER[0][unit.window]
        first = unit.loads(self.symbols)[place]
        order = _refine(unit, self.symbols, place, first, digest)
        self.place, self.first, self.digest = place[order], first[order], digest[order]
        same = self.digest[1:] == self.digest[:-1]
        self.marks = np.zeros(len(self.symbols), bool)
        self.marks[self.place[1:][same]] = True
        self.marks[self.place[:-1][same]] = True

    def prefix(self, at: np.ndarray, length: int) -> np.ndarray:
        return self.hashes[at + length] - self.hashes[at] * _POWER[0][length]

    def find(self, other: Level) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows of ``other`` belong in this order, and which stand at that
        place (an index), or -1."""
        lo = np.searchsorted(self.first, other.first, "left")
        equal, hi = np.full(len(lo), -1), lo.copy()
        open_ = np.flatnonzero(self.first[np.minimum(lo, len(self.first) - 1)] == other.first)
        hi[open_] = np.searchsorted(self.first, other.first[open_], "right")
        open_ = open_[lo[open_] < hi[open_]]
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            same = self.digest[mid] == other.digest[open_]
            equal[open_[same]] = lo[open_[same]] = mid[same]
            open_, mid = open_[~same], mid[~same]
            before = self._before(other, other.place[open_], self.place[mid])
            hi[open_[before]] = mid[before]
            lo[open_[~before]] = mid[~before] + 1
            open_ = open_[lo[open_] < hi[open_]]
        return lo, equal

    def _before(self, other: Level, theirs: np.ndarray, mine: np.ndarray) -> np.ndarray:
        """Whether their windows go before mine; none are equal, all share a load."""
        length, step = np.full(len(mine), self.unit.span), 256
        while step:
            far = np.flatnonzero(length + step < self.unit.window)
            a, b = mine[far] + length[far], theirs[far] + length[far]
            length[far[self.prefix(a, step) == other.prefix(b, step)]] += step
            step //= 2
        return other.symbols[theirs + length] < self.symbols[mine + length]

    def scan(self, other: Level) -> np.ndarray:
        """Marks what the two have in common; returns where other's windows belong."""
        place, equal = self.find(other)
        hit = equal >= 0
        other.marks[other.place[hit]] = True
        # the windows of this level that equal one another are marked already
        self.marks[self.place[equal[hit]]] = True
        return place

    def merge(self, other: Level, where: np.ndarray) -> Level:
        """This level with the windows of ``other`` at the places ``where``."""
        n, shift = len(self.place), len(self.symbols)
        theirs = np.zeros(n + len(where), bool)
        theirs[where + np.arange(len(where))] = True

        def both(a, b):
            out = np.empty(len(theirs), a.dtype)
            out[theirs], out[~theirs] = b, a
            return out

        self.place, self.first, self.digest = both(self.place, other.place + shift), both(self.first, other.first), both(self.digest, other.digest)
        for name in ("numbers", "widths", "symbols", "hashes", "marks"):
            setattr(self, name, np.concatenate((getattr(self, name), getattr(other, name))))
        self.offsets = np.concatenate((self.offsets, other.offsets + shift))
        self.batches += other.batches
        return self

    def found(self):
        """(number, marks of its windows) of each text with a mark."""
        for number, at, n in zip(self.numbers.tolist(), self.offsets.tolist(), self.widths.tolist()):
            own = self.marks[at : at + n]
            if own.any():
                yield number, own


class Family:
    """The levels, the largest first."""

    def __init__(self, unit: Unit):
        self.unit = unit
        self.levels: list[Level] = []

    def add(self, parts: list[tuple[int, np.ndarray]]) -> None:
        level = Level(self.unit, parts)
        where = [old.scan(level) for old in self.levels]
        while self.levels and self.levels[-1].batches <= level.batches:
            old = self.levels.pop()
            level = old.merge(level, where.pop() if level.batches == 1 else old.find(level)[0])
        self.levels.append(level)

    def found(self):
        for level in self.levels:
            yield from level.found()
