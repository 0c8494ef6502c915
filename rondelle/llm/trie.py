"""Binary trie self-join over sorted 64-bit values, in numpy.

A sorted array is a binary trie: a node is a range of values that share their
leading bits. Pairs of nodes are traversed together, differing bits are added
up on the way down, and a pair is dropped once they exceed the budget.
"""

from __future__ import annotations

import numpy as np

#: Pairs of nodes expanded at once, and value pairs compared at once.
FRONTIER = 50_000
LEAVES = 1_000_000
#: A pair of nodes with so many value pairs at most is compared directly.
DIRECT = 64
#: Over a budget of NARROW bits the upper nodes prune next to nothing: nodes of WIDE values at most are compared as blocks.
NARROW, WIDE = 3, 256


def settle(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def merge(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Joins the classes of i[k] and j[k]; parent maps each value to its class's first."""
    while True:
        a, b = parent[i], parent[j]
        differ = a != b
        if not differ.any():
            return parent
        low, high = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
        np.minimum.at(parent, high, low)
        parent = settle(parent)


def classes(values: np.ndarray, key_bits: int, budget: int) -> np.ndarray:
    """For each of the sorted distinct uint64 values the index of its class's first value.

    Two values are linked if they share the first ``key_bits`` bits and differ
    in at most ``budget`` of the others. Small budgets run first, so that dense
    groups are one class early: a pair of nodes whose values all are of one
    class is not entered again. Memory: the values plus bounded frontiers.
    """
    n = len(values)
    parent = np.arange(n)
    if n < 2:
        return parent
    keys = values >> np.uint64(64 - key_bits)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    ends = np.r_[starts[1:], n]
    wide = ends - starts > 1
    for spend in sorted({1, budget}) if budget > 1 else [budget]:
        parent = _pass(values, parent, starts[wide], ends[wide], key_bits, spend)
    return parent


def _pass(values, parent, lo, hi, depth, budget):
    stack = [(depth, np.stack([lo, hi, lo, hi, np.zeros_like(lo)]))]
    changes = _changes(parent)
    while stack:
        depth, rows = stack.pop()
        if rows.shape[1] > FRONTIER:
            stack += [(depth, part) for part in np.array_split(rows, -(-rows.shape[1] // FRONTIER), axis=1)]
            continue
        alo, ahi, blo, bhi, spent = rows
        # one class throughout: nothing to gain
        one = (changes[ahi - 1] == changes[alo]) & (changes[bhi - 1] == changes[blo]) & (parent[alo] == parent[blo])
        rows = rows[:, ~one]
        alo, ahi, blo, bhi, spent = rows
        wide = budget > NARROW
        direct = ((np.maximum(ahi - alo, bhi - blo) <= WIDE) if wide else ((ahi - alo) * (bhi - blo) <= DIRECT)) | (depth >= 64)
        if direct.any():
            before = parent
            parent = (_compare_blocks if wide else _compare)(values, parent, rows[:, direct], budget)
            if parent is not before:
                changes = _changes(parent)
        rows = rows[:, ~direct]
        if rows.shape[1]:
            stack.append((depth + 1, _children(values, rows, depth, budget)))
    return parent


def _changes(parent):
    return np.cumsum(np.r_[0, parent[1:] != parent[:-1]])


def _children(values, rows, depth, budget):
    alo, ahi, blo, bhi, spent = rows
    bit = np.uint64(1) << np.uint64(63 - depth)
    above = ~((bit << np.uint64(1)) - np.uint64(1)) if depth else np.uint64(0)
    amid = np.clip(np.searchsorted(values, (values[alo] & above) | bit), alo, ahi)
    bmid = np.clip(np.searchsorted(values, (values[blo] & above) | bit), blo, bhi)
    same = alo == blo
    out = [
        np.stack([alo, amid, blo, bmid, spent]),
        np.stack([amid, ahi, bmid, bhi, spent]),
        np.stack([alo, amid, bmid, bhi, spent + 1]),
        np.stack([amid, ahi, blo, bmid, spent + 1])[:, ~same],
    ]
    out = np.concatenate(out, axis=1)
    return out[:, (out[1] > out[0]) & (out[3] > out[2]) & (out[4] <= budget)]


def _compare(values, parent, rows, budget):
    sizes = (rows[1] - rows[0]) * (rows[3] - rows[2])
    edges = np.r_[0, np.cumsum(sizes)]
    at = 0
    while at < rows.shape[1]:
        upto = max(at + 1, int(np.searchsorted(edges, edges[at] + LEAVES, "right")) - 1)
        alo, _, blo, bhi, _ = rows[:, at:upto]
        each = sizes[at:upto]
        row = np.repeat(np.arange(upto - at), each)
        nth = np.arange(len(row)) - np.repeat(edges[at:upto] - edges[at], each)
        width = (bhi - blo)[row]
        i, j = alo[row] + nth // width, blo[row] + nth % width
        near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
        if near.any():
            parent = merge(parent, i[near], j[near])
        at = upto
    return parent


def _compare_blocks(values, parent, rows, budget):
    """_compare for wide nodes: each pair of nodes is one block of differences, without index arrays."""
    held, size = [], 0
    for alo, ahi, blo, bhi, _ in rows.T.tolist():
        i, j = np.divmod(np.flatnonzero(np.bitwise_count(values[alo:ahi, None] ^ values[None, blo:bhi]) <= budget), bhi - blo)
        i, j = i + alo, j + blo
        near = i < j
        held.append((i[near], j[near]))
        size += len(held[-1][0])
        if size >= LEAVES:
            parent, held, size = merge(parent, *map(np.concatenate, zip(*held, strict=True))), [], 0
    if size:
        parent = merge(parent, *map(np.concatenate, zip(*held, strict=True)))
    return parent
