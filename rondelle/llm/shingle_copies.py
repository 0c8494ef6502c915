"""Near copies by word shingles: SimHash fingerprints in a trie propose groups, min-hash bands add what lies further apart, exact set similarity decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .near_dedup import fingerprints, trie_links
from .shared import drop_folder, stash, stash_at, text_or_empty
from .simhash import ascii_lower, let, shingles

#: Bits that two fingerprints may differ in to propose their texts. A wider radius links texts by chance: at 10 bits 0.1
#: of the others for each of 12 million texts, at 13 bits 11, and such links would tie all groups into one.
RADIUS = 10
#: Two texts of similarity s share no band with probability (1 - s**BAND_ROWS)**BANDS: 6e-5 at 0.8, 3e-9 at 0.87.
BANDS, BAND_ROWS = 32, 6
#: Texts and shingles of a proposed group that one block holds; each pair of blocks is a task's unit of work.
BLOCK_TEXTS, BLOCK_SHINGLES = 500, 500_000
#: Shingles hashed, and postings counted, at once.
HASHED, COUNTED = 32_768, 1_000_000


def shingle_hashes(text: Column, k: int) -> Column:
    """XXH64 (seed 42) of each shingle, repeats included; a text without words has one empty shingle."""
    return let(F.transform(shingles(ascii_lower(text), k), lambda s: F.xxhash64(s)), lambda hs: F.when(F.size(hs) > 0, hs).otherwise(F.array(F.xxhash64(F.lit("")))))


def band_keys(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One key for each band and text (BANDS x texts); flat holds the hashes of all texts, none of them empty."""
    factors = np.random.default_rng(42).integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    keys = np.empty((BANDS, len(starts)), np.uint64)
    ends = np.r_[starts[1:], len(flat)]
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + HASHED, "right")))
        own, edges = flat[starts[at] : ends[upto - 1]], starts[at:upto] - starts[at]
        for band in range(BANDS):
            key = np.full(upto - at, band + 1, np.uint64)
            for factor in factors[band * BAND_ROWS : (band + 1) * BAND_ROWS]:
                key = (key ^ np.minimum.reduceat(own * factor, edges)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            keys[band, at:upto] = key
        at = upto
    return keys


def banded(hashes: DataFrame) -> DataFrame:
    """(key, row) for each band of each row of (row, hashes)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, lists = batch.column(0).to_numpy(), batch.column(1)
                starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
                got = band_keys(lists.flatten().to_numpy().view(np.uint64), starts)
                yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64).ravel()), pa.array(np.tile(row, BANDS))], names=["key", "row"])

    return hashes.mapInArrow(keys, "key bigint, row bigint")


def alike(flat: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    """For each of the sets (distinct hashes, one set after another) the first set of its class; sets of similarity ``least`` or more are linked."""
    from .trie import merge

    n = len(sizes)
    parent = np.arange(n)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")  # stable, so owners ascend within a hash
    values, posted = flat[order], owner[order]
    first = np.r_[True, values[1:] != values[:-1]]
    token = np.empty(len(flat), np.int64)
    token[order] = np.cumsum(first) - 1
    begin = np.flatnonzero(first)
    length = np.diff(np.r_[begin, len(flat)])
    edges = np.r_[0, np.cumsum(sizes)]
    for i in range(n - 1):
        own = token[edges[i] : edges[i + 1]]
        own = own[length[own] > 1]
        if not len(own):
            continue
        each, shared, at = length[own], np.zeros(n, np.int64), 0
        upto = np.cumsum(each)
        while at < len(own):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] - each[at] + COUNTED, "right")))
            size = each[at:to]
            nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            shared += np.bincount(posted[np.repeat(begin[own[at:to]], size) + nth], minlength=n)
            at = to
        near = np.flatnonzero(shared[i + 1 :] + 1e-9 >= least * (sizes[i] + sizes[i + 1 :] - shared[i + 1 :])) + i + 1
        if len(near):
            parent = merge(parent, np.full(len(near), i), near)
    return parent


def similar_links(dealt: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join the similar rows of each unit of (root, one, two, row, hashes): a spanning forest, not the pairs."""

    def links(unit: list[tuple[int, np.ndarray]]):
        rows = np.array([r for r, _ in unit])
        parent = alike(np.concatenate([h for _, h in unit]), np.array([len(h) for _, h in unit]), least)
        tied = np.flatnonzero(parent != np.arange(len(parent)))
        if len(tied):
            yield pa.RecordBatch.from_arrays([pa.array(rows[parent[tied]]), pa.array(rows[tied])], names=["a", "b"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for key, row, own in zip(keys, batch.column(3).to_pylist(), batch.column(4), strict=True):
                if key != last and held:
                    yield from links(held)
                    held = []
                held.append((row, own.values.to_numpy()))
                last = key
        if held:
            yield from links(held)

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    unit = ["root", "one", "two"]
    return dealt.select(*unit, "row", "hashes").repartition(n, *unit).sortWithinPartitions(*unit).mapInArrow(join, "a bigint, b bigint")


def fingerprint_links(texts: DataFrame, shingle_words: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that join all rows of (row, text) whose SimHash fingerprints differ in at most ``radius`` bits."""
    fps = stash(fingerprints(texts.select(F.col("row").alias("doc_id"), "text"), shingle_words).select(F.col("doc_id").alias("row"), "fp"), "simhash")
    distinct = stash(fps.groupBy("fp").agg(F.min("row").alias("rep"), F.count("*").alias("n")), "distinct")
    equal = fps.join(distinct.where("n > 1"), "fp").where("row <> rep").select(F.col("rep").alias("a"), F.col("row").alias("b"))
    return trie_links(distinct.select("fp", "rep"), radius, radius + 1).unionByName(equal)


def similar_components(texts: DataFrame, least: float = 0.8, shingle_words: int = 5) -> DataFrame:
    """(row, component) of each row of (row, text) that is tied to another; component is the smallest row.

    Two rows are tied if the Jaccard similarity of their sets of word shingles
    is ``least`` or more. Rows whose fingerprints the trie links are proposed,
    and rows that share a min-hash band, as texts of that similarity may lie
    further apart than the trie's radius; each proposed group is then compared
    exactly, all pairs of it, in blocks that are dealt out as units, so that no
    task holds a large group.
    """
    near = fingerprint_links(texts, shingle_words)
    hashes = texts.select("row", shingle_hashes(F.col("text"), shingle_words).alias("hashes"))
    bands, at = stash_at(banded(hashes), "bands")
    heads = bands.groupBy("key").agg(F.min("row").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head")
    proposed = connected(near.unionByName(bands.join(heads, "key").where("row <> head").select(F.col("head").alias("a"), F.col("row").alias("b"))).distinct())
    drop_folder(texts.sparkSession, at)  # connected has written the links
    members = stash(proposed.select(F.col("node").alias("row"), "root").unionByName(proposed.select(F.col("root").alias("row"), "root").distinct()), "members")
    sets = texts.join(members, "row").select("row", "root", F.array_distinct(shingle_hashes(F.col("text"), shingle_words)).alias("hashes"))
    sets = stash(sets, "sets")
    sized = sets.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum(F.size("hashes")) / BLOCK_SHINGLES)).alias("blocks"))
    placed = sets.join(sized, "root").withColumn("own", F.pmod(F.xxhash64("row"), F.col("blocks")))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    tied = similar_links(dealt.select("root", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "row", "hashes"), least)
    roots = stash(connected(tied), "tied")
    return roots.select(F.col("node").alias("row"), F.col("root").alias("component")).unionByName(roots.select(F.col("root").alias("row"), F.col("root").alias("component")).distinct())


def without_near_copies(docs: DataFrame, least: float = 0.8, shingle_words: int = 5) -> DataFrame:
    """One row of docs for each group of rows that are tied by similar texts.

    The row of the smallest doc_id stays, a null one only where the group has no
    other; of rows with equal or only null ids exactly one stays. Rows are
    decided on one by one, so a row whose doc_id also stands in a dropped row
    stays if its own text is no copy. Words are runs of anything but ASCII white
    space after lower-casing A-Z; a text of fewer words than a shingle is one
    shingle. Null counts as empty, and texts without words are alike.
    """
    rows = stash(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    texts = rows.select("row", text_or_empty("doc.text").alias("text"))
    tied = rows.select("row", F.col("doc.doc_id").alias("doc_id")).join(similar_components(texts, least, shingle_words), "row")
    # false sorts before true: a row with an id is less than one without
    first = tied.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    dropped = tied.join(first, "component").where("row <> first.row").select("row")
    return rows.join(dropped, "row", "left_anti").select("doc.*")
