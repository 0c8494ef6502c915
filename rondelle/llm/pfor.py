"""Patched frame-of-reference blocks for token ids.

A file image holds documents in order::

    header   magic, documents, ids, blocks
    docs     doc_id int64 each, one byte each that says if it is there, length uint32 each
    index    byte offset of each block's packed bits (uint64), and of its exceptions (uint32 count so far)
    frames   minimum (uint32) and width (uint8) of each block
    packed   per block the low ``width`` bits of (id - minimum), most significant bit first
    patches  place in the block (uint16) and missing high bits (uint32) of each exception

The width of a block covers the given share of its values; the others keep
their low bits in place and their high bits in the exception list.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"PFOR1\0\0\0"
BLOCK = 128
#: Big-endian, so that a value's bits stand in order.
WORD = np.dtype(">u4")
PERCENTILE = 90


def _bits(x: np.ndarray) -> np.ndarray:
    """Number of bits of each value."""
    out = np.zeros(x.shape, np.int64)
    for b in (16, 8, 4, 2, 1):
        big = x >> b > 0
        out += np.where(big, b, 0)
        x = np.where(big, x >> b, x)
    return out + (x > 0)


def encode(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    n = len(ids)
    blocks = -(-n // block)
    padded = np.zeros(blocks * block, np.int64)
    padded[:n] = ids
    if n % block:
        padded[n:] = padded[n - 1]
    grid = padded.reshape(blocks, block)
    low = grid.min(axis=1) if blocks else np.zeros(0, np.int64)
    grid = grid - low[:, None]
    at = min(block - 1, -(-block * percentile // 100) - 1)
    width = _bits(np.partition(grid, at, axis=1)[:, at]) if blocks else np.zeros(0, np.int64)
    over = grid >> width[:, None]
    row, place = np.nonzero(over)
    parts: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        for some in np.array_split(own, -(-len(own) // 2048)):
            bits = np.unpackbits(grid[some].astype(WORD).view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - w :]
            for i, packed in zip(some, np.packbits(bits.reshape(len(some), -1), axis=1), strict=True):
                parts[i] = packed.tobytes()
    starts = np.r_[0, np.cumsum([len(p) for p in parts])].astype("<u8")
    patched = np.r_[0, np.cumsum(np.bincount(row, minlength=blocks))].astype("<u4")
    present = np.array([d is not None for d in doc_ids], np.uint8)
    known = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([
        MAGIC, struct.pack("<QQQQ", len(doc_ids), n, blocks, block), known.tobytes(), present.tobytes(), np.asarray(lengths, "<u4").tobytes(),
        starts.tobytes(), patched.tobytes(), low.astype("<u4").tobytes(), width.astype(np.uint8).tobytes(), *parts, place.astype("<u2").tobytes(), over[row, place].astype("<u4").tobytes(),
    ])


class Reader:
    """Random access to a file image: documents, and ids of any range by way of the block index."""

    def __init__(self, image: bytes):
        if image[:8] != MAGIC:
            raise ValueError("not a PFOR1 image")
        docs, self.n, self.blocks, self.block = struct.unpack_from("<QQQQ", image, 8)
        at = 40

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(image, kind, count, at)
            at += out.nbytes
            return out

        known, present, self.lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
        self.doc_ids = [int(d) if p else None for d, p in zip(known, present, strict=True)]
        self.starts, self.patched = take("<u8", self.blocks + 1), take("<u4", self.blocks + 1)
        self.low, self.width = take("<u4", self.blocks), take("u1", self.blocks)
        self.packed = take("u1", int(self.starts[-1]) if self.blocks else 0)
        patches = int(self.patched[-1]) if self.blocks else 0
        self.place, self.high = take("<u2", patches), take("<u4", patches)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids first..last-1 (uint32), read from the blocks that hold them."""
        last = self.n if last is None else min(last, self.n)
        if last <= first:
            return np.zeros(0, "<u4")
        a, b = first // self.block, -(-last // self.block)
        out = np.zeros((b - a, self.block), np.int64)
        width = self.width[a:b]
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            if not w:
                continue
            size = -(-self.block * int(w) // 8)
            for some in np.array_split(own, -(-len(own) // 2048)):
                raw = self.packed[self.starts[a:b][some].astype(np.int64)[:, None] + np.arange(size)]
                bits = np.unpackbits(raw, axis=1)[:, : self.block * int(w)].reshape(-1, int(w))
                whole = np.zeros((len(bits), 32), np.uint8)
                whole[:, 32 - int(w) :] = bits
                out[some] = np.packbits(whole, axis=1).view(WORD).reshape(len(some), self.block)
        p, q = int(self.patched[a]), int(self.patched[b])
        row = np.repeat(np.arange(b - a), np.diff(self.patched[a : b + 1].astype(np.int64)))
        place = self.place[p:q].astype(np.int64)
        out[row, place] |= self.high[p:q].astype(np.int64) << width[row].astype(np.int64)
        flat = (out + self.low[a:b, None]).reshape(-1)
        return flat[first - a * self.block : last - a * self.block].astype("<u4")
