"""Document fingerprints (native): weighted SimHash of whole texts and of edited texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stash, text_or_empty
from .simhash import ascii_lower, hex16, let, vote, within_radius, words

#: A term's weight is its number of characters, up to this many: the short
#: function words that all texts of a language share count for little.
MOST_WEIGHT = 16


def terms(text: Column) -> Column:
    """The distinct words and distinct pairs of neighbouring words of a text."""
    return let(words(ascii_lower(text)), _terms)


def _terms(ws: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(0), F.size(ws) - 2), lambda i: F.concat_ws(" ", F.get(ws, i), F.get(ws, i + 1)))
    none = F.array().cast("array<string>")
    return F.concat(F.array_distinct(ws), F.when(F.size(ws) >= 2, F.array_distinct(pairs)).otherwise(none))


def fingerprint_rows(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``fp`` (BIGINT) for each row; keys must tell the rows apart."""
    each = df.select(*keys, F.explode_outer(terms(F.col(text))).alias("_term"))
    hashed = each.select(*keys, F.when(F.col("_term").isNotNull(), F.xxhash64("_term")).alias("_h"), F.least(F.length("_term"), F.lit(MOST_WEIGHT)).alias("_w"))
    return vote(hashed, keys, "_h", "_w")


def with_next_text(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Adds to each row its place (bucket, pos) in ascending doc_id order, and the next row's place and text.

    The order is cut into buckets at approximate quantiles of doc_id, so that
    one shuffle of the texts serves the order and no task gets all rows. Rows
    of one doc_id are ordered by text; null ids come first; the last row's next
    is the first.
    """
    n = buckets or min(2048, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    cuts = F.expr("array(" + ",".join(f"{b}L" if b != -(1 << 63) else "CAST('-9223372036854775808' AS BIGINT)" for b in bounds) + ")") if bounds else None
    bucket = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.size(F.filter(cuts, lambda b: b < F.col("doc_id")))) if bounds else F.lit(0)
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("bucket", bucket)
    heads = rows.groupBy("bucket").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("_id"))
    one = W.orderBy("bucket")
    turn = W.partitionBy(F.lit(0))
    # at most as many rows as buckets: one task may hold them
    heads = heads.select(F.col("bucket").alias("_head"), "_id", F.coalesce(F.lag("bucket").over(one), F.max("bucket").over(turn)).alias("_before"))
    least = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    first = rows.select(F.col("bucket").alias("_b"), least.alias("_i"), "text").join(F.broadcast(heads), (F.col("_b") == F.col("_head")) & (F.col("_i") == F.col("_id")))
    first = first.groupBy("_before", "_head").agg(F.min("text").alias("_head_text"))
    order = W.partitionBy("bucket").orderBy("doc_id", "text")
    placed = rows.select("*", F.row_number().over(order).alias("pos"), F.lead("text").over(order).alias("_lead"))
    out = placed.join(first, F.col("bucket") == F.col("_before"), "left")
    last = F.col("_lead").isNull()
    return out.select("doc_id", "text", "bucket", "pos", F.when(last, F.col("_head")).otherwise(F.col("bucket")).alias("next_bucket"), F.when(last, F.lit(1)).otherwise(F.col("pos") + 1).alias("next_pos"), F.coalesce("_lead", "_head_text").alias("next_text"))


def edited_text(text: Column, following: Column) -> Column:
    """The last floor(n/4) code points replaced by the first as many (or all) of the following text."""
    n = F.length(text)
    r = (n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - r), F.substring(following, F.lit(1), r))


def likeness(a: str, b: str) -> Column:
    return F.lit(1.0) - F.expr(f"bit_count({a} ^ {b})") / 64.0


def fingerprint_documents(docs: DataFrame, radius: int = 3) -> DataFrame:
    """Fingerprints of every document and of its edited text, and who is near whom.

    Input: doc_id, text; other columns are left aside. One row per input row,
    repeated rows included: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, and near_distinct: for
    doc_id divisible by 20, the number of other fingerprints within ``radius``
    bits among all documents (null for other rows). A null text is empty; a
    text without words has fingerprint 0; a null doc_id sorts first. An empty
    table gives an empty result.
    """
    rows = with_next_text(docs).withColumn("_edited", edited_text(F.col("text"), F.col("next_text")))
    keys = ["bucket", "pos", "doc_id", "n_chars", "next_bucket", "next_pos", "edited_sha256", "_side"]
    sides = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited_sha256", F.sha2("_edited", 256))
    sides = sides.withColumn("_s", F.explode(F.array(F.struct(F.lit(0).alias("_side"), "text"), F.struct(F.lit(1).alias("_side"), F.col("_edited").alias("text")))))
    sides = sides.select(*keys[:-1], "_s._side", F.col("_s.text").alias("text"))
    both = fingerprint_rows(sides, keys).groupBy(*keys[:-1])
    fps = stash(both.agg(F.max(F.when(F.col("_side") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("_side") == 1, F.col("fp"))).alias("edited_fp")), "fingerprints")
    following = fps.select(F.col("bucket").alias("next_bucket"), F.col("pos").alias("next_pos"), F.col("fp").alias("next_fp"))
    distinct = fps.select("fp").distinct()
    asked = fps.where(F.col("doc_id") % 20 == 0).select(F.col("fp").alias("query_fp")).distinct()
    near = within_radius(asked, distinct, radius).groupBy(F.col("query_fp").alias("fp")).agg((F.count("*") - 1).alias("near_distinct"))
    out = fps.join(following, ["next_bucket", "next_pos"], "left").join(near, "fp", "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", hex16(F.col("fp")).alias("fingerprint"), hex16(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
        F.when(F.col("doc_id") % 20 == 0, F.col("near_distinct")).alias("near_distinct"),
    )
