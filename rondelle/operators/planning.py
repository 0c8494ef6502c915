"""Budgets and plans of a run: compaction, request bounds, grids, numbering, gates."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Options that one choice request can hold.
BATCH = 254


def head_summary(text: str, most: int) -> str:
    """Default summarizer: the first ``most`` characters."""
    return text[:most]


def fold_history(costs: list[int], texts: list[str], budget: int, summarize: Callable[[str, int], str] = head_summary, overhead: int = 0) -> tuple[str, list[int], int]:
    """(summary, places of the recent units, number of folds) after streaming units into a budget.

    A unit that would overflow first folds summary and recent units into a new
    summary of at most a quarter of the budget; if it overflows even alone, it
    is folded too. Costs add up: summary, units and overhead.
    """
    if budget <= 0:
        raise ValueError("the budget must be positive")
    summary, recent, folds = "", [], 0
    fits = lambda own: overhead + len(summary) + sum(costs[i] for i in own) <= budget
    for i in range(len(texts)):
        if fits([*recent, i]):
            recent.append(i)
            continue
        while not fits([*recent, i]) and recent:
            summary, recent, folds = summarize("\n\n".join(t for t in [summary, *(texts[j] for j in recent)] if t), budget // 4), [], folds + 1
        if fits([i]):
            recent = [i]
            continue
        summary, recent, folds = summarize("\n\n".join(t for t in [summary, texts[i]] if t), budget // 4), [], folds + 1
        if not fits(recent):
            raise RuntimeError("the summary alone is over the budget")
    return summary, recent, folds


def compact(units: DataFrame, group: str, order: str, text: str, budget: int, summarize: Callable[[str, int], str] = head_summary) -> DataFrame:
    """fold_history of each group (a conversation): group, summary, recent (values of order), folds."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        texts = [t or "" for t in pdf[text]]
        summary, recent, folds = fold_history([len(t) for t in texts], texts, budget, summarize)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "summary": [summary], "recent": [[int(pdf[order].iloc[i]) for i in recent]], "folds": [folds]})

    kind = units.schema[group].dataType.simpleString()
    return units.select(group, order, text).groupBy(group).applyInPandas(fold, f"{group} {kind}, summary string, recent array<bigint>, folds bigint")


def choice_batches(n: Column) -> Column:
    return F.ceil(n / BATCH).cast("bigint")


def within_turn_requests(chunks: Column) -> Column:
    """Most requests that linking so many nodes of one turn can take: over all splits into topics, sub-topics and details.

    With s topics and p sub-topics it is p * ceil(s / BATCH) + (n - s - p) *
    ceil(p / BATCH). Within a batch both factors are fixed, so the total is
    linear in s and in p: only the ends of batches can hold the maximum.
    """
    starts = lambda most: F.filter(F.concat(F.array(F.lit(0).cast("bigint")), F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor(most / BATCH)), lambda k: k * BATCH + 1)), lambda x: x <= most)
    ends = lambda most: F.transform(F.sequence(F.lit(1).cast("bigint"), F.floor(most / BATCH) + 1), lambda k: F.least(k * BATCH, most))
    cost = lambda s, p: p * F.ceil(s / BATCH) + (chunks - s - p) * F.ceil(p / BATCH)
    each = F.transform(starts(chunks), lambda s: F.array_max(F.transform(F.concat(starts(chunks - s), ends(chunks - s)), lambda p: cost(s, p))))
    return F.array_max(each).cast("bigint")


def projected_requests(chunks: Column, topics: Column, subs: Column, details: Column) -> Column:
    """Most requests of one turn: a classification of each chunk, links within the turn, and the merge of each node."""
    same = choice_batches(topics + subs + details + chunks)
    belongs = choice_batches(subs + chunks) + choice_batches(topics + chunks)
    return chunks + within_turn_requests(chunks) + chunks * (same + belongs)


def numbered(items: DataFrame, group: str, order: str, prefix: str) -> DataFrame:
    """Adds qid: prefix, group and a running two-digit number within the group."""
    n = F.row_number().over(W.partitionBy(group).orderBy(order))
    return items.withColumn("qid", F.format_string(f"{prefix}%02d_%02d", F.col(group).cast("int"), n))


def grid(spark, arms: list[str], weights: list[float], injections: list[str]) -> DataFrame:
    """Every meaningful run: weight 0 needs no injection mode, so those runs are one."""
    lists = spark.createDataFrame([(arms, weights, injections)], "a array<string>, w array<double>, i array<string>")
    each = lists.select(F.explode("a").alias("arm"), "w", "i").select("arm", F.explode("w").alias("w"), "i").select("arm", "w", F.explode("i").alias("inject"))
    return each.withColumn("inject", F.when(F.col("w") == 0, "none").otherwise(F.col("inject"))).distinct()


def ratio_gate(bad: Column, total: Column, most: float) -> Column:
    """Whether a run must stop: too large a share; nothing counted never stops it."""
    return F.coalesce((total > 0) & (bad / total > most), F.lit(False))


def should_replace(current: Column, candidate: Column, margin: float = 0.05) -> Column:
    return (candidate - current) > margin


def strictly_grows(shares: DataFrame, group: str, order: str, value: str, least_ratio: float) -> DataFrame:
    """Whether a value strictly grows along an order, and its last is at least a ratio of its first."""
    w = W.partitionBy(group).orderBy(order)
    steps = shares.withColumn("_up", F.coalesce(F.col(value) > F.lag(value).over(w), F.lit(True)))
    return steps.groupBy(group).agg(F.bool_and("_up").alias("grows"), (F.max_by(value, order) >= least_ratio * F.min_by(value, order)).alias("enough"))


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many keys are in both, only in a, only in b."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, key, "full_outer")
    n = lambda c: F.count(F.when(c, 1))
    return j.agg(n(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), n(F.col("_b").isNull()).alias("only_a"), n(F.col("_a").isNull()).alias("only_b"))


def blinded(a: DataFrame, b: DataFrame, key: str, seed: str) -> DataFrame:
    """Two result sets as one, in an order that tells nothing: anonymous_id, source, key and the columns both share."""
    both = a.withColumn("source", F.lit("a")).unionByName(b.withColumn("source", F.lit("b")))
    return both.withColumn("anonymous_id", F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("source"), F.col(key).cast("string")), 256), 1, 16))
