"""Exact, cached use of the tokenizer files in Python workers.

A text is cut at white space into units whose tokens do not depend on their
neighbours; a unit's ids are looked up in a bounded table and encoded only when
they are not there. Texts for which that independence is not certain go through
the tokenizers library whole. Both ways give the library's ids.
"""

from __future__ import annotations

import json
import os
import re
import struct

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import regex
from tokenizers import Tokenizer

#: The pre-tokenizer patterns that the two tokenizer files name.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: A white space on both sides of a space (or a space at the end after one):
#: there the byte-level pattern makes tokens that reach across the space.
ACROSS = re.compile(r"\s \s|\s \Z")

#: Code points for which lower-casing, composition and letter classes are the
#: same in every Unicode version in use: no combining marks, no U+0130, no
#: separators that Python alone takes for white space.
UNSURE = re.compile("[^\x00-\x1b\x20-įı-ɏЀ-џ‐-‧ぁ-ゖァ-ヺ一-龥]")

#: ASCII characters that are sure; what is left of a text's bytes without them is searched for unsure ones.
SURE_ASCII = bytes([*range(0x00, 0x1C), *range(0x20, 0x7F)])

#: Marks that are a piece of their own after letters.
MARKS = frozenset(",.;:!?")

#: Entries of a worker's unit table, and characters of a unit that is kept: about 200 bytes each.
CACHE_ENTRIES = 600_000
LONGEST_KEPT = 64

#: The two patterns within ASCII, for the plain regex engine: the same pieces, found faster.
ASCII_PATTERN = {
    BYTE_LEVEL_PATTERN: r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+",
    WORD_PATTERN: r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\sA-Za-z0-9]+",
}


def byte_level_alphabet() -> list[str]:
    """Character that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


_TO_LEVEL = {i: c for i, c in enumerate(byte_level_alphabet())}
_FROM_LEVEL = {c: i for i, c in _TO_LEVEL.items()}


def to_level(piece: str) -> str:
    if piece.isascii():
        return piece.translate(_TO_LEVEL)
    return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(_TO_LEVEL)


_LOADED: dict = {}


def load(path: str) -> Tokenizer:
    """The tokenizer of a file, without truncation and padding; kept per worker process."""
    if path not in _LOADED:
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _LOADED[path] = tok
    return _LOADED[path]


class Recent(dict):
    """A bounded table that makes what it lacks (``make``) and forgets what was not asked for of late.

    Entries come in two generations of half the limit each: when the young one
    (the dict itself) is full it becomes the old one, and an old entry that is
    asked for again is young again. So frequent words stay, however many rare
    ones pass.
    """

    def __init__(self, make, limit: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.old, self.half = make, {}, max(1, limit // 2)

    def __missing__(self, key: str):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


def piece_finder(pattern: str):
    """text -> its pieces by one of the two pre-tokenizer patterns."""
    every, within_ascii = regex.compile(pattern).findall, re.compile(ASCII_PATTERN[pattern], re.ASCII).findall
    return lambda text: (within_ascii if text.isascii() else every)(text)


class Units(Recent):
    """Unit -> its ids as little-endian unsigned 32-bit integers.

    A unit's pieces (a word without its comma, say) are units themselves, so
    they share the table. ``known`` are two tables that stay and are looked up
    first: ids of words behind a space (True; without it) and of others (False).
    Memory is bounded for any corpus.
    """

    def __init__(self, path: str, known: dict[bool, dict[str, bytes]] | None = None, limit: int = CACHE_ENTRIES):
        super().__init__(self.encode_unit, limit)
        self.spaced, self.plain = (known[True], known[False]) if known else ({}, {})
        self.tok, self.model = load(path), load(path).model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.lower = spec["normalizer"] is not None
        self.find = piece_finder(WORD_PATTERN if self.lower else BYTE_LEVEL_PATTERN)

    def encode_piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece if piece.isascii() and piece.isalpha() else to_level(piece))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_unit(self, unit: str) -> bytes:
        spaced = unit[:1] == " "
        word = unit[1:] if spaced else unit
        ids = (self.spaced if spaced else self.plain).get(word)
        if ids is not None:
            return ids
        if word.isalpha():  # letters are one piece, with the space before them
            return self.encode_piece(unit)
        if word[-1:] in MARKS and word[:-1].isalpha():
            return self[unit[:-1]] + self[unit[-1]]
        found = self.find(unit)
        return b"".join(map(self.__getitem__, found)) if len(found) > 1 else b"".join(map(self.encode_piece, found))

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; null is the empty text."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.whole(text)
        if self.lower:
            rare = text.encode("utf-8", "surrogatepass").translate(None, SURE_ASCII)
            if rare and UNSURE.search(rare.decode("utf-8", "surrogatepass")):
                return self.whole(text)
            return b"".join(map(self.__getitem__, text.lower().split()))
        if ACROSS.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        if not self.spaced:
            return self[first] + b"".join([self[" " + u] for u in rest])
        found = list(map(self.spaced.get, rest))
        if None in found:
            found = [self[" " + u] if ids is None else ids for u, ids in zip(rest, found)]
        return self[first] + b"".join(found)


def units_of(path: str, known: dict[bool, dict[str, bytes]] | None = None, key: object = None) -> Units:
    """One table per worker process, tokenizer and known table; workers live on from task to task."""
    at = ("units", path, key)
    if at not in _LOADED:
        for k in [k for k in _LOADED if isinstance(k, tuple) and k[:2] == at[:2]]:
            del _LOADED[k]
        _LOADED[at] = Units(path, known, CACHE_ENTRIES // 2 if known else CACHE_ENTRIES)
    return _LOADED[at]


def pieces_by_id(path: str) -> list[bytes]:
    """Bytes of every id of a byte-level tokenizer; special tokens stand for their own text."""
    at = ("pieces", path)
    if at not in _LOADED:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        out = {i: bytes(_FROM_LEVEL[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
        out.update({t["id"]: t["content"].encode() for t in spec["added_tokens"]})
        _LOADED[at] = [out.get(i, b"") for i in range(max(out) + 1)]
    return _LOADED[at]
