"""Best-fit packing: minimum bin slack over the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stash

CAPACITY = 2048


def fullest(counts: list[int], room: int) -> list[int]:
    """Lengths of the fullest combination of available items with at most ``room`` in all, longest first.

    counts[n] items of length n are available. ``reach`` is a bitset: bit s is
    set if some combination sums to s. Lengths are added from the longest on,
    each as often as it is available (in powers of two), and the sets before
    each step are kept for the way back. It ends early once ``room`` itself can
    be reached.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n in range(min(room, len(counts) - 1), 0, -1):
        left, times = min(counts[n], room // n), 1
        while left:
            use = min(times, left)
            grown = (reach | reach << (n * use)) & mask
            if grown != reach:
                steps.append((n, use, reach))
                reach = grown
            left -= use
            times *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for n, use, before in reversed(steps):
        if not before >> total & 1:
            out += [n] * use
            total -= n * use
    return sorted(out, reverse=True)


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(number of bins, lengths in each) that use up a histogram of lengths.

    Minimum bin slack: a bin takes the longest item left and the fullest
    feasible combination for the rest of its room, which is then removed. Items
    of one length are alike, so the same bin is made as often as its items last;
    the work depends on the number of lengths (at most ``capacity``), not on the
    number of items.
    """
    counts = [0] * (capacity + 1)
    for n, c in histogram.items():
        counts[n] = c
    out = []
    for longest in range(capacity, 0, -1):
        while counts[longest]:
            counts[longest] -= 1
            items = [longest, *fullest(counts, capacity - longest)]
            counts[longest] += 1
            need = {n: items.count(n) for n in set(items)}
            bins = min(counts[n] // c for n, c in need.items())
            for n, c in need.items():
                counts[n] -= bins * c
            out.append((bins, items))
    return out


def places(made: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from_rank, to_rank, in_bin, first_sequence, first_offset) that say where the items of a length go, by rank."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for bins, items in made:
        for n in dict.fromkeys(items):
            c, start = items.count(n), used.get(n, 0)
            out.append((n, start, start + c * bins, c, sequence, sum(x for x in items if x > n)))
            used[n] = start + c * bins
        sequence += bins
    return out


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids with the end id, cut at ``capacity``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import units_of

        units, end = units_of(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids, doc = units.encode(text.as_py()) + end, doc.as_py()
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(pieces: DataFrame, capacity: int = CAPACITY, salts: int = 64) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``capacity``.

    The histogram (at most ``capacity`` rows) goes to the driver, which fills
    the bins; rows then find their place by their rank among the rows of their
    length. Ranks are counted within (length, salt) and moved on by the sizes of
    the salts before, so a length of a third of all rows has no task of its own.
    """
    spark = pieces.sparkSession
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")
    rows = pieces.withColumn("_salt", salt)
    sizes = {(r["length"], r["_salt"]): r["count"] for r in rows.groupBy("length", "_salt").count().collect()}  # capacity * salts rows at most
    histogram: dict[int, int] = {}
    before = []
    for (n, s), c in sorted(sizes.items()):
        before.append((n, s, histogram.get(n, 0)))
        histogram[n] = histogram.get(n, 0) + c
    where = places(patterns(histogram, capacity))
    offsets = spark.createDataFrame(before, "length bigint, _salt int, _before bigint")
    spots = spark.createDataFrame(where, "_n bigint, _from bigint, _to bigint, _in_bin bigint, _sequence bigint, _offset bigint")
    turn = F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32"))
    # both tables are bounded by the capacity (and salts), whatever the corpus
    ranked = rows.withColumn("_turn", turn).join(F.broadcast(offsets), ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_turn") - 1)
    found = ranked.join(F.broadcast(spots), (F.col("length") == F.col("_n")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    nth = F.col("_rank") - F.col("_from")
    return found.select(*pieces.columns, (F.col("_sequence") + F.expr("(_rank - _from) div _in_bin")).alias("sequence_id"), (F.col("_offset") + F.pmod(nth, F.col("_in_bin")) * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as minimum bin slack finds.

    Input: doc_id, text; other columns are left aside. One row per piece: doc_id,
    piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is
    one piece with the end id alone; repeated rows are packed each; null ids are
    kept. An empty table gives an empty result. Only documents longer than the
    capacity are cut.
    """
    return pack(stash(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
