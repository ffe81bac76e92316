"""Byte-level byte-pair tokens: counts by heap merging, identifiers by the library.

Text is cut at single spaces and line feeds first.  The pre-tokeniser's pattern
never lets a token begin before such a space or run across such a line feed, so
every cut piece can be tokenised alone and remembered.  Texts in which two white
space characters touch go through the whole pattern instead.

The memories are caches with a fixed number of entries (``CACHE_ENTRIES``, for identifiers
``ID_ENTRIES``); once one
is full, further pieces are computed each time, which changes speed and never results.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
import re
from array import array

CACHE_ENTRIES, ID_ENTRIES = 500_000, 100_000
_ADJACENT_SPACE = re.compile(r"\s\s")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: bytes that
    print keep their own character, the others take 256 onwards in byte order."""
    keep = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in set(keep):
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class _Cache(dict):
    """A bounded memory of a function of a string."""

    def __init__(self, compute, prefix: str = "", entries: int = CACHE_ENTRIES):
        super().__init__()
        self.compute, self.prefix, self.entries = compute, prefix, entries

    def __missing__(self, key):
        value = self.compute(self.prefix + key)
        if len(self) < self.entries:
            self[key] = value
        return value


class MergeCounter:
    """Counts tokens from a merge table without producing identifiers."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.start = [vocab[c] for c in symbols]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int, int]] = []
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.parts.append((vocab[a], vocab[b], vocab[a + b]))
            self.rank.setdefault(self.parts[-1][:2], r)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special_split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.find = regex.compile(pattern).findall
        self.words = _Cache(self._merge_text)
        self.first = _Cache(self._pieces)
        self.spaced = _Cache(self._pieces, " ")

    def _merge_text(self, word: str) -> int:
        return self.merge(list(map(self.start.__getitem__, word.encode("utf-8", "surrogatepass"))))

    def merge(self, symbols: list[int]) -> int:
        """Initial symbols minus merges.  The heap holds rank and left position in
        one integer; an entry whose neighbours have changed since is skipped."""
        n = len(symbols)
        if n < 2:
            return n
        rank, parts = self.rank, self.parts
        heap = [r << 32 | i for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            entry = heapq.heappop(heap)
            i = entry & 0xFFFFFFFF
            left, right, joined = parts[entry >> 32]
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = joined, -1
            k = after[i] = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (r := rank.get((joined, symbols[k]))) is not None:
                    heapq.heappush(heap, r << 32 | i)
            p = before[i]
            if p >= 0 and (r := rank.get((symbols[p], joined))) is not None:
                heapq.heappush(heap, r << 32 | p)
        return n - merges

    def _pieces(self, text: str) -> int:
        return sum(map(self.words.__getitem__, self.find(text)))

    def _plain(self, text: str) -> int:
        if _ADJACENT_SPACE.search(text):
            return self._pieces(text)
        lines = text.split("\n")
        total, first, spaced = len(lines) - 1, self.first.__getitem__, self.spaced.__getitem__
        for line in lines:
            head, *rest = line.split(" ")
            total += first(head) + sum(map(spaced, rest))
        return total

    def count(self, text: str) -> int:
        if self.special_split is None or not any(s in text for s in self.special):
            return self._plain(text)
        parts = self.special_split.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


class IdEncoder:
    """Identifiers of whole texts as little-endian unsigned 32-bit bytes, remembered
    by piece.

    A new piece is encoded from ``ranks``, the same vocabulary ordered by merge rank:
    that is the order of the merges, and the merges inside a piece see nothing
    outside it, so the identifiers are those of the tokeniser file.  Texts that hold
    a special string go through the tokeniser file itself.
    """

    def __init__(self, path: str, pattern: str, ranks: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken

        self.path, self.tokenizer = path, None
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        with open(ranks, "rb") as f:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.first = _Cache(self._pieces, entries=ID_ENTRIES)
        self.spaced = _Cache(self._pieces, " ", ID_ENTRIES)
        self.feed = self._pieces("\n")

    def _pieces(self, text: str) -> bytes:
        return array("I", self.plain(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            if self.tokenizer is None:  # read when first needed: it takes memory in every worker
                from tokenizers import Tokenizer

                self.tokenizer = Tokenizer.from_file(self.path)
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if _ADJACENT_SPACE.search(text):
            return self._pieces(text)
        out, first, spaced = [], self.first.__getitem__, self.spaced.__getitem__
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append(self.feed)
            head, *rest = line.split(" ")
            out.append(first(head))
            out.extend(map(spaced, rest))
        return b"".join(out)


_kept: dict = {}


def kept(kind, *args: str):
    """One counter or encoder per Python worker and files."""
    key = (kind.__name__, *args)
    if key not in _kept:
        _kept[key] = kind(*args)
    return _kept[key]
