"""Prompts under a budget: context blocks, whole-prompt windows, question fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What stands between the blocks of a context, and around it.
SEPARATOR = "\n\n"
OPEN, CLOSE = "<context>\n", "\n</context>"


def assemble(block: Column, units: Column) -> Column:
    """The context of an optional block and an array of units, in their order."""
    parts = F.filter(F.concat(F.array(block), units), lambda x: x.isNotNull())
    return F.concat(F.lit(OPEN), F.array_join(F.when(F.coalesce(block, F.lit("")) == "", units).otherwise(parts), SEPARATOR), F.lit(CLOSE))


def reader_prompt(context: Column, question: Column, head: str = "", between: str = "\n\nQuestion: ", tail: str = "\nAnswer:") -> Column:
    return F.concat(F.lit(head), context, F.lit(between), question, F.lit(tail))


def planet_lines(block: Column) -> Column:
    """Lines of a block that are a node with a mass."""
    return F.size(F.filter(F.split(block, r"\r?\n"), lambda x: F.trim(x).startswith("[PN")))


def prompt_window(units: DataFrame, group: str, order: str, text: str, scaffold: Column, block: Column, budget: int, tokens, pinned: Column | None = None) -> DataFrame:
    """The newest whole units that fit the budget together with the whole prompt; one row for each group.

    ``scaffold`` is the length of the prompt without block and units, ``block``
    the text kept before the units (null or empty for none), both the same for
    all rows of a group; ``tokens`` gives tokens from a number of characters and
    must not fall as it grows, so the first unit that does not fit ends the
    window. Units marked ``pinned`` are always kept. Columns: group,
    window_tokens, n_recent, first_recent, context. A prompt that is too long
    even without units fails the query.
    """
    kept_always = F.coalesce(pinned, F.lit(False)) if pinned is not None else F.lit(False)
    gap = len(SEPARATOR)
    rows = units.select(F.col(group).alias(group), F.col(order).alias("_at"), F.col(text).alias("_unit"), scaffold.alias("_scaffold"), F.coalesce(block, F.lit("")).alias("_block"), kept_always.alias("_pinned"))
    size = F.length("_unit") + gap
    newest = W.partitionBy(group).orderBy(F.desc("_at")).rowsBetween(W.unboundedPreceding, 0)
    always = F.sum(F.when(F.col("_pinned"), size).otherwise(0)).over(W.partitionBy(group))
    run = F.sum(F.when(F.col("_pinned"), 0).otherwise(size)).over(newest)
    # a separator stands before each part but the first
    base = F.col("_scaffold") + F.when(F.col("_block") != "", F.length("_block")).otherwise(-gap)
    rows = rows.withColumn("_kept", F.col("_pinned") | (tokens(F.greatest(base + always + run, F.col("_scaffold"))) <= budget))
    own = F.struct(F.col("_at").alias("at"), F.col("_unit").alias("unit"), F.col("_pinned").alias("pinned"))
    out = rows.groupBy(group).agg(F.first("_scaffold").alias("_scaffold"), F.first("_block").alias("_block"), F.array_sort(F.collect_list(F.when(F.col("_kept"), own))).alias("_units"))
    context = assemble(F.col("_block"), F.col("_units.unit"))
    out = out.withColumn("context", context).withColumn("window_tokens", tokens(F.col("_scaffold") + F.length("context") - len(OPEN) - len(CLOSE)))
    over = F.raise_error(F.concat(F.lit("window exceeds the budget even without units: "), F.col(group).cast("string"))).cast("bigint")
    recent = F.filter("_units", lambda u: ~u["pinned"])
    return out.select(group, F.when(F.col("window_tokens") <= budget, F.col("window_tokens")).otherwise(over).alias("window_tokens"), F.size(recent).cast("bigint").alias("n_recent"), F.get(recent, 0)["at"].alias("first_recent"), "context")


def longest_question(questions: DataFrame, group: str, question: str, context: Column, tokens) -> DataFrame:
    """(group, question, prompt_tokens): the question whose whole prompt is longest, the first by text of equal ones."""
    size = tokens(F.length(reader_prompt(context, F.col(question))))
    least = F.min(F.struct((-size).alias("n"), F.col(question).alias("q")))
    return questions.groupBy(group).agg(least.alias("x")).select(group, F.col("x.q").alias("question"), (-F.col("x.n")).alias("prompt_tokens"))


def question_fit(questions: DataFrame, question: str, context: Column, budget: int, tokens) -> DataFrame:
    """Adds prompt_tokens of each question's whole prompt, and if it fits."""
    size = tokens(F.length(reader_prompt(context, F.col(question))))
    return questions.withColumn("prompt_tokens", size).withColumn("fits", F.col("prompt_tokens") <= budget)
