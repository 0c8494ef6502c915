"""From messages to round trips, renderings and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def round_trips(messages: DataFrame) -> DataFrame:
    """Pair each user message with the assistant message that answers it.

    ``messages``: conv_id, turn, role, text. A row per round trip: conv_id,
    round_trip (0-based, in order of emission), user_text, assistant_text. The
    missing side of an unpaired message is empty. Other roles stand alone and do
    not part a user message from its answer. An unanswered user message is
    emitted just before the next user message, or at the end.
    """
    speaker = F.col("role").isin("user", "assistant")
    w = W.partitionBy("conv_id", F.col("role").isin("user", "assistant")).orderBy("turn")
    m = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    m = m.withColumn("_next", F.when(speaker, F.lead("role").over(w))).withColumn("_next_text", F.lead("text").over(w)).withColumn("_next_turn", F.lead("turn").over(w)).withColumn("_prev", F.when(speaker, F.lag("role").over(w)))
    paired = (F.col("role") == "user") & F.col("_next").eqNullSafe("assistant")
    alone = (F.col("role") == "user") & ~F.col("_next").eqNullSafe("assistant")
    rows = m.where(~((F.col("role") == "assistant") & F.col("_prev").eqNullSafe("user")))
    at = F.when(paired, F.col("_next_turn") * 2).when(alone, F.coalesce(F.col("_next_turn") * 2 - 1, F.lit(2**62))).otherwise(F.col("turn") * 2)
    rows = rows.select(
        "conv_id", at.alias("_at"), F.col("turn").alias("_turn"),
        F.when(F.col("role") == "assistant", "").when(F.col("role") == "user", F.col("text")).otherwise(F.col("text")).alias("user_text"),
        F.when(paired, F.col("_next_text")).when(F.col("role") == "assistant", F.col("text")).otherwise("").alias("assistant_text"),
    )
    return rows.select("conv_id", (F.row_number().over(W.partitionBy("conv_id").orderBy("_at", "_turn")) - 1).cast("bigint").alias("round_trip"), "user_text", "assistant_text")


def labelled_pairs(messages: DataFrame) -> DataFrame:
    """round_trips of user and assistant messages alone, trimmed and prefixed with the speaker."""
    kept = messages.where(F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role", F.trim(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''")
    label = lambda c, who: F.when(F.col(c) != "", F.concat(F.lit(f"{who}: "), F.col(c))).otherwise("").alias(c)
    return round_trips(kept).select("conv_id", "round_trip", label("user_text", "User"), label("assistant_text", "Assistant"))


def render_round_trip(user: Column, assistant: Column) -> Column:
    return F.concat(F.lit("### Human\n"), user, F.lit("\n"), F.when(assistant != "", F.concat(F.lit("### text\n"), assistant)).otherwise(""))


def render_session(messages: DataFrame) -> DataFrame:
    """conv_id, session: role lines in turn order."""
    line = F.struct("turn", F.concat(F.upper("role"), F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))
    return messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("_l")).select("conv_id", F.array_join(F.col("_l.line"), "\n").alias("session"))


def newest_within(units: DataFrame, group: str, order: str, cost: str, budget: int, keep_one: bool = False) -> DataFrame:
    """The newest whole units whose costs add up to at most the budget, stopping at the first misfit.

    Adds ``kept`` to each row. Costs must be positive; then "stop at the first
    misfit" is the same as a running total within the budget.
    """
    newest = W.partitionBy(group).orderBy(F.desc(order))
    total = F.sum(cost).over(newest.rowsBetween(W.unboundedPreceding, 0))
    kept = total <= budget
    if keep_one:
        kept = kept | (F.row_number().over(newest) == 1)
    return units.withColumn("kept", kept)


def summaries_then_last(units: DataFrame, group: str, order: str, text: str, summary: str, last: int) -> DataFrame:
    """Adds ``shown``: the summary of all but the last k units, those whole."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc(order)))
    return units.withColumn("shown", F.when(rank <= last, F.col(text)).otherwise(F.col(summary)))


def tail_text(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.lit("...\n"), F.right(text, F.lit(most)))).otherwise(text)


def every_nth_with_recent(units: DataFrame, group: str, order: str, value: str, n: int = 5) -> DataFrame:
    """Fires at every n-th unit of a group with the sum over the last n units."""
    w = W.partitionBy(group).orderBy(order)
    rows = units.withColumn("count", F.row_number().over(w).cast("bigint")).withColumn("recent", F.sum(value).over(w.rowsBetween(1 - n, 0)))
    return rows.where(F.col("count") % n == 0)


def admitted(units: DataFrame, group: str, order: str, requests: str, tokens: str, most_requests: int, most_tokens: int) -> DataFrame:
    """Adds ``admitted``: requests so far fit, and the tokens spent before are under their limit."""
    w = W.partitionBy(group).orderBy(order)
    asked = F.sum(requests).over(w.rowsBetween(W.unboundedPreceding, 0))
    spent = F.coalesce(F.sum(tokens).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return units.withColumn("admitted", (asked <= most_requests) & (spent < most_tokens))
