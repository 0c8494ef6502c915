"""Token counts by heap-and-linked-list byte-pair merging, without ids."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import ACROSS, BYTE_LEVEL_PATTERN, Recent, piece_finder, to_level

#: Words, and pieces of words, whose counts a worker keeps.
CACHE_WORDS = 800_000


class Merges:
    """Ranks of the symbol pairs of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.special = [t["content"] for t in spec["added_tokens"]]

    def count(self, piece: str) -> int:
        """Tokens of one piece: its symbols less the merges.

        A heap holds the known pairs of neighbours by rank, then place; symbols
        are a linked list. The lowest pair is merged, its two new neighbour
        pairs go on the heap, and entries whose symbols have changed since are
        passed over.
        """
        symbols = list(piece)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.ranks
        heap = [(ranks[pair], i, pair) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if pair in ranks]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != pair[0] or j >= n or symbols[j] != pair[1]:
                continue
            symbols[i], symbols[j] = pair[0] + pair[1], ""
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                right = (symbols[i], symbols[k])
                if right in ranks:
                    heapq.heappush(heap, (ranks[right], i, right))
            h = before[i]
            if h >= 0:
                left = (symbols[h], symbols[i])
                if left in ranks:
                    heapq.heappush(heap, (ranks[left], h, left))
        return n - merges


class Counts(Recent):
    """Word -> number of tokens; a word but the first of a text begins with its space. Its pieces share the table."""

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        super().__init__(self.plain, limit=limit)
        self.merges, self.find = Merges(path), piece_finder(BYTE_LEVEL_PATTERN)

    def plain(self, text: str) -> int:
        found = self.find(text)
        return sum(map(self.__getitem__, found)) if len(found) > 1 else sum(self.merges.count(to_level(p)) for p in found)

    def text(self, text: str | None) -> int:
        """Tokens of a whole text; a special token's text is one token, and what stands between is split apart."""
        if not text:
            return 0
        for s in self.merges.special:
            if s in text:
                parts = text.split(s)
                return len(parts) - 1 + sum(map(self.text, parts))
        if ACROSS.search(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        return self[first] + sum([self[" " + w] for w in rest])


_COUNTS: dict[str, Counts] = {}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every whole text.

    For byte-level tokenizer files. Input: doc_id, text; other columns are left
    aside. Null is the empty text: 0 bytes, 0 tokens. Repeated rows and null ids
    stay; an empty table gives an empty result. Nothing is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _COUNTS:
            _COUNTS[tokenizer] = Counts(tokenizer)
        counts = _COUNTS[tokenizer]
        for batch in batches:
            size, tokens = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                size.append(len(text.encode()))
                tokens.append(counts.text(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
