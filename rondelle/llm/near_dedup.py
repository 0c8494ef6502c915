"""SimHash near-dedup: a binary trie self-join over fingerprints, and its components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .shared import join_sized, stash, text_or_empty
from .simhash import ascii_lower, blocks_for, hex16, permutations, shingles, tables, vote

#: Values joined at once in a task, unless one key alone has more.
BATCH_VALUES = 400_000


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp) for each row of docs: majority of the XXH64 (seed 42) bits of all word shingles."""
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("_row", F.monotonically_increasing_id())
    each = rows.select("_row", "doc_id", F.explode_outer(shingles(ascii_lower(F.col("text")), shingle_words)).alias("_s"))
    hashed = each.select("_row", "doc_id", F.when(F.col("_s").isNotNull(), F.xxhash64("_s")).alias("_h"))
    return vote(hashed, ["_row", "doc_id"], "_h").select("doc_id", "fp")


def trie_links(distinct: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """Links (a, b) that join all rows whose fp differ in at most ``radius`` bits.

    ``distinct`` has ``fp`` (distinct) and ``rep``. Fingerprints within the
    radius agree in some choice of blocks; each choice deals the trie out by
    the value of those blocks, and a task traverses its subtrees. A task sends
    a spanning forest of what it has linked, not the pairs: at most one link for
    each fingerprint and choice. ``blocks`` (over ``radius``) sets the number of
    blocks; with radius + 1 of them there are as many tables, which a wide
    radius needs.
    """
    if blocks is None:
        blocks = blocks_for(distinct.count(), radius)
    key_bits = [width for _, width in permutations(radius, blocks)]
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tables(distinct, "fp", radius, blocks).select("table_no", "block", "perm", "rep").repartition(n, "table_no", "block")
    # unsigned order, so that the values of a key stand together in trie order
    dealt = dealt.withColumn("_order", F.expr("perm ^ CAST('-9223372036854775808' AS BIGINT)")).sortWithinPartitions("table_no", "_order").select("table_no", "perm", "rep")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, full = 0, BATCH_VALUES

        def links(table, perm, rep):
            for t in np.unique(table):
                own = np.flatnonzero(table == t)
                parent = _classes(perm[own].view(np.uint64), key_bits[t], radius)
                tied = np.flatnonzero(parent != np.arange(len(parent)))
                if len(tied):
                    yield pa.RecordBatch.from_arrays([pa.array(rep[own][parent[tied]]), pa.array(rep[own][tied])], names=["a", "b"])

        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            size += batch.num_rows
            if size >= full:
                table, perm, rep = (np.concatenate(x) for x in zip(*held, strict=True))
                shift = np.array(key_bits, np.uint64)[table]
                key = perm.view(np.uint64) >> (np.uint64(64) - shift)
                new = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1]))
                cut = new[-1] + 1 if len(new) else 0  # the last key may go on in the next batch
                if cut:
                    yield from links(table[:cut], perm[:cut], rep[:cut])
                held, size = [(table[cut:], perm[cut:], rep[cut:])], len(table) - cut
                full = max(BATCH_VALUES, 2 * size)  # a long key is copied a few times, not once a batch
        if size:
            yield from links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return dealt.mapInArrow(join, "a bigint, b bigint")


def _classes(values, key_bits, radius):
    from .trie import classes

    return classes(values, key_bits, radius)


def near_duplicates(docs: DataFrame, radius: int = 3, shingle_words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs.

    Words are runs of anything but ASCII white space after lower-casing A-Z.
    component_id is the smallest doc_id reachable over links between
    fingerprints of at most ``radius`` differing bits. Null and empty texts have
    fingerprint zero and are linked like any other, texts of any length are read
    whole, repeated rows stay. A row with a null doc_id links like any other
    and gets its component's smallest id (null if the component has no id).
    Equal fingerprints are joined once, so groups of copies cost one row each.
    An empty table gives an empty result.
    """
    fps = stash(fingerprints(docs, shingle_words), "simhash")
    distinct = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "distinct")
    # the nodes are the fingerprints, so that rows without an id carry links too
    roots = connected(trie_links(distinct.select("fp", F.col("fp").alias("rep")), radius)).select(F.col("node").alias("fp"), "root")
    # large components are few, one row each after the map-side minimum
    rooted = stash(distinct.join(roots, "fp", "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    component = join_sized(rooted.select("fp", "copies", "root"), least, "root", "members", rooted.count())
    out = join_sized(fps, component.select("fp", "copies", "component_id"), "fp", "copies", fps.count())
    return out.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
