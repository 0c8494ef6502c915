"""BPE encoding through a distinct-word table, decoding through an id-to-piece join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stash, text_or_empty

#: Words of the table that is sent to the executors, the most frequent ones, and
#: the characters of each at most: about 25 MB sent, 120 MB in a worker.
TABLE_WORDS = 1 << 19
WORD_CHARS = 64

#: White space in the tokenizer's sense (fixed value: the Unicode property).
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


#: How frequent a word is, in eighths of a power of two.
EIGHTH = "floor(8 * log2(n))"


def splittable(text: Column, special: list[str]) -> Column:
    """True where a text's words can be encoded apart.

    Not so where white space stands on both sides of a space, as the
    pre-tokenizer then makes pieces across it, or where a special token's text
    occurs.
    """
    out = ~text.rlike(f"{SPACE} (?:{SPACE}|\\z)")
    for s in special:
        out = out & ~F.contains(text, F.lit(s))
    return out


def word_counts(docs: DataFrame, special: list[str]) -> DataFrame:
    """(word, n) over all texts; a word but the first of a text begins with its space."""
    texts = docs.select(text_or_empty().alias("text")).where(splittable(F.col("text"), special))
    words = texts.select(F.posexplode(F.split("text", " ")).alias("pos", "bare"))
    # the space is put on after the count, so that no string is made for a position
    counts = words.groupBy("bare", (F.col("pos") > 0).alias("spaced")).agg(F.count("*").alias("n"))
    word = F.when(F.col("spaced"), F.concat(F.lit(" "), F.col("bare"))).otherwise(F.col("bare"))
    return counts.select(word.alias("word"), "n").where("word <> ''")


def word_table(docs: DataFrame, tokenizer: str, limit: int = TABLE_WORDS) -> DataFrame:
    """(word, ids): the words met more than once, each encoded once; the most frequent ones, ``limit`` at most.

    A word met once is encoded where it stands, which is once as well.
    """
    from .tokens import Units

    counts = stash(word_counts(docs, Units(tokenizer).special).where(f"n > 1 AND length(word) <= {WORD_CHARS}"), "counts")
    # counts by eighths of a power of two: under 600 rows for any corpus, so that no task sorts or gathers the words
    sizes = {r["at"]: r["n"] for r in counts.groupBy(F.expr(EIGHTH).alias("at")).agg(F.count("*").alias("n")).collect()}
    taken, least = 0, None
    for at in sorted(sizes, reverse=True):
        taken += sizes[at]
        if taken > limit:
            break
        least = at
    frequent = counts.where(F.expr(EIGHTH) >= least if least is not None else F.lit(False)).select("word")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from .tokens import load

        tok = load(tokenizer)
        for batch in batches:
            words = batch.column(0).to_pylist()
            ids = [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(words, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["word", "ids"])

    return frequent.repartition(n).mapInArrow(encode, "word string, ids binary")


def encode_decode(docs: DataFrame, tokenizer: str, limit: int = TABLE_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    Words are split and counted in Spark and each frequent one is encoded once.
    The table of at most ``limit`` words goes to every executor, where ids are
    joined back by position; words beyond it are encoded where they stand, so
    no position is shuffled and no size of vocabulary fails. Ids are joined with
    the tokenizer's table of pieces to decode. Input: doc_id, text; other
    columns are left aside. Null is the empty text: no tokens. Repeated rows and
    null ids stay; an empty table gives an empty result.
    """
    table = stash(word_table(docs, tokenizer, limit), "words")
    known: dict[bool, dict[str, bytes]] = {True: {}, False: {}}  # at most ``limit`` words, by whether a space stands before
    for r in table.toLocalIterator():
        spaced = r["word"].startswith(" ")
        known[spaced][r["word"][spaced:]] = bytes(r["ids"])
    sent = docs.sparkSession.sparkContext.broadcast(known)
    key = sent._jbroadcast.id()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from .tokens import pieces_by_id, units_of

        units = units_of(tokenizer, sent.value, key)
        pieces = np.array(pieces_by_id(tokenizer), object)
        decimal = np.array([str(i).encode() for i in range(len(pieces))], object)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = np.frombuffer(units.encode(text.as_py()), "<u4")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(b",".join(decimal[ids])).hexdigest())
                decoded = b"".join(pieces[ids]).decode("utf-8", "replace")
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(join, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
