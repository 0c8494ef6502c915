"""Nearest candidates by similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import dot

THRESHOLD = 0.92


def best_match(queries: DataFrame, candidates: DataFrame, key: str, threshold: float = THRESHOLD, own: bool = True) -> DataFrame:
    """The most similar candidate of each query within its key; the first by order wins a tie.

    ``queries``: key, query_id, vector. ``candidates``: key, candidate_id, ord,
    vector. Gives query_id, candidate_id, score, matched (score at the threshold
    or over). A query without candidates has no candidate and score 0; without
    ``own`` a candidate of the query's id does not count. Candidates are reduced
    map-side by max, so no list of a query's candidates is ever gathered.
    """
    q = queries.select(key, "query_id", F.col("vector").alias("_q"))
    c = candidates.select(F.col(key).alias("_k"), "candidate_id", "ord", F.col("vector").alias("_c"))
    on = F.col(key) == F.col("_k")
    if not own:
        on = on & (F.col("query_id") != F.col("candidate_id"))
    # a query without candidates keeps its row: the join is an outer one
    pairs = q.join(c, on, "left").select("query_id", "candidate_id", (-F.col("ord")).alias("_first"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(F.col("_q"), F.col("_c")))).alias("score"))
    best = pairs.groupBy("query_id").agg(F.max(F.when(F.col("candidate_id").isNotNull(), F.struct("score", "_first", "candidate_id"))).alias("b"))
    score = F.coalesce("b.score", F.lit(0.0))
    return best.select("query_id", F.col("b.candidate_id").alias("candidate_id"), score.alias("score"), (F.col("b.candidate_id").isNotNull() & (score >= threshold)).alias("matched"))


def spread_score(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """1 - 2 |mean pairwise cosine - 0.5| of unit vectors by key, without pairs: (|sum v|^2 - n) / (n (n - 1))."""
    parts = vectors.select(key, F.posexplode(vector)).groupBy(key, "pos").agg(F.sum(F.col("col").cast("double")).alias("s"), F.count("*").alias("n"), F.sum(F.col("col").cast("double") * F.col("col").cast("double")).alias("q"))
    total = parts.groupBy(key).agg(F.sum(F.col("s") * F.col("s")).alias("_ss"), F.max("n").alias("n"), F.sum("q").alias("_n"))
    mean = (F.col("_ss") - F.col("_n")) / (F.col("n") * (F.col("n") - 1))
    return total.select(key, "n", F.when(F.col("n") < 2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - 2 * F.abs(mean - 0.5))).alias("contradiction"))


def duplicate_share(vectors: DataFrame, key: str, order: str, vector: str, threshold: float = THRESHOLD, sample: int = 300) -> DataFrame:
    """Share of pairs at the threshold or over among at most ``sample`` rows of a key, taken by a hash of their id.

    The sample is the operator's own feature: it bounds the pairs of a key.
    """
    few = vectors.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.md5(F.col(order).cast("string")), order))).where(F.col("_r") <= sample)
    a, b = few.select(key, F.col("_r").alias("_i"), F.col(vector).alias("_a")), few.select(F.col(key).alias("_k"), F.col("_r").alias("_j"), F.col(vector).alias("_b"))
    pairs = a.join(b, (F.col(key) == F.col("_k")) & (F.col("_i") < F.col("_j")))
    return pairs.groupBy(key).agg(F.count("*").alias("pairs"), F.count(F.when(dot(F.col("_a"), F.col("_b")) >= threshold, 1)).alias("duplicates"))


#: The scores of a judged match and of none.
MATCH, NO_MATCH = 1.0, 0.0


def judged_match(queries: DataFrame, candidates: DataFrame, key: str, ask: Callable[[Column, Column], Column], shortlist: int = 5) -> DataFrame:
    """The first candidate of each query within its key that a judge says yes to, nearest first.

    ``queries``: key, query_id, text, vector. ``candidates``: key, candidate_id,
    ord, text, vector. ``ask`` gives a boolean column for a query's and a
    candidate's text; it is asked for the ``shortlist`` nearest candidates (the
    first by order of those as near), or, with 0, for all in their order. Gives
    query_id, candidate_id, score: a match's, or that of none with the candidate
    that came first. A query without candidates has none; a judge's null is no.
    """
    q = queries.select(key, "query_id", F.col("text").alias("_qt"), F.col("vector").alias("_q"))
    c = candidates.select(F.col(key).alias("_k"), "candidate_id", "ord", F.col("text").alias("_ct"), F.col("vector").alias("_c"))
    pairs = q.join(c, F.col(key) == F.col("_k"), "left")
    near = [F.desc_nulls_last(dot(F.col("_q"), F.col("_c")))] if shortlist else []
    pairs = pairs.withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy(*near, "ord")))
    if shortlist:
        pairs = pairs.where(F.col("_r") <= shortlist)
    yes = F.col("candidate_id").isNotNull() & F.coalesce(ask(F.col("_qt"), F.col("_ct")), F.lit(False))
    found = pairs.groupBy("query_id").agg(F.min(F.when(yes, F.struct("_r", "candidate_id"))).alias("y"), F.min(F.struct("_r", "candidate_id")).alias("n"))
    return found.select("query_id", F.coalesce("y.candidate_id", "n.candidate_id").alias("candidate_id"), F.when(F.col("y").isNotNull(), MATCH).otherwise(NO_MATCH).alias("score"))


def link_within_turn(nodes: DataFrame, turn: list[str], belongs: Callable[[Column, Column], Column]) -> DataFrame:
    """Adds parent_id: nodes of one turn linked to each other only.

    ``nodes``: the columns of ``turn``, node_id, seq, level (0 topic, 1
    sub-topic, 2 detail), text. A sub-topic goes to the first topic of its turn,
    a detail to the first sub-topic, that ``belongs`` (child's text, parent's
    text) says yes to; what finds none, and every topic, has no parent.
    """
    up = nodes.where("level < 2").select(*[F.col(c).alias(f"_{c}") for c in turn], F.col("node_id").alias("_id"), F.col("seq").alias("_seq"), F.col("level").alias("_up"), F.col("text").alias("_text"))
    on = (F.col("level") == F.col("_up") + 1) & F.coalesce(belongs(F.col("text"), F.col("_text")), F.lit(False))
    for c in turn:
        on = on & (F.col(c) == F.col(f"_{c}"))
    first = nodes.join(up, on).groupBy(*turn, "node_id").agg(F.min(F.struct("_seq", "_id")).alias("_p")).select(*turn, "node_id", F.col("_p._id").alias("parent_id"))
    return nodes.join(first, [*turn, "node_id"], "left").select(*nodes.columns, "parent_id")
