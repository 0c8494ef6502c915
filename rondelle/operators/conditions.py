"""Answer sets against questions: verdicts, summaries, and paired cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .scoring import tier1


def verdicts(df: DataFrame, gold: str, aliases: str, answer: str, judged: Column | None = None) -> DataFrame:
    """Adds verdict (pass, fail or indeterminate), tier and matched_alias to each question with its answer.

    A match by rule passes in tier 1. An answer that is empty once scrubbed, or
    says that it does not know, fails in tier 1. Any other takes what ``judged``
    says (a boolean column: tier 2), and stays indeterminate where that is null
    or not given. A missing answer counts as empty.
    """
    rows = tier1(df.withColumn("_answer", F.coalesce(F.col(answer), F.lit(""))), gold, aliases, "_answer")
    ruled = F.lit(None).cast("boolean") if judged is None else judged
    silent = (T.scrub(F.col("_answer")) == "") | T.is_no_answer(F.col("_answer"))
    verdict = F.when(F.col("passed"), "pass").when(silent, "fail").when(ruled, "pass").when(~ruled, "fail").otherwise("indeterminate")
    tier = F.when(F.col("passed") | silent | ruled.isNull(), 1).otherwise(2)
    return rows.withColumn("verdict", verdict).withColumn("tier", tier).drop("_answer", "passed")


def count_of(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def summary(scored: DataFrame, *group: str) -> DataFrame:
    """n_pass, n_fail, n_indeterminate, total and pass_rate of each group; what is indeterminate has not passed."""
    is_ = lambda v: count_of(F.col("verdict") == v)
    out = scored.groupBy(*group).agg(is_("pass").alias("n_pass"), is_("fail").alias("n_fail"), is_("indeterminate").alias("n_indeterminate"), F.count("*").alias("total"))
    return out.withColumn("pass_rate", F.round(F.col("n_pass") / F.col("total"), 4))


def multi_gold_answers(df: DataFrame, group: str, gold: str, answer: str) -> DataFrame:
    """(group, n): answers that hold two or more different golds of their group's questions, a sign of echoing.

    The different golds of a group meet its different answers in a join, which
    keeps the second gold found at most: answers are counted by their copies.
    """
    folded = df.select(F.col(group).alias(group), T.normalise(F.coalesce(gold, F.lit(""))).alias("_gold"), T.normalise(F.coalesce(answer, F.lit(""))).alias("_said"))
    golds = folded.where("_gold <> ''").select(group, "_gold").distinct()
    said = folded.groupBy(group, "_said").agg(F.count("*").alias("_copies"))
    found = said.join(golds, (said[group] == golds[group]) & F.contains(said["_said"], golds["_gold"])).select(said[group], "_said", "_copies")
    held = found.groupBy(group, "_said").agg(F.max("_copies").alias("_copies"), F.count("*").alias("_golds")).where("_golds >= 2")
    return df.select(group).distinct().join(held.groupBy(group).agg(F.sum("_copies").alias("_n")), group, "left").select(group, F.coalesce("_n", F.lit(0)).alias("n"))


def compute_summary(df: DataFrame, metrics: list[str], *group: str) -> DataFrame:
    """<metric>_mean over the rows that have it (null if none has) and <metric>_missing for each group."""
    each = [x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), count_of(F.col(m).isNull()).alias(f"{m}_missing"))]
    return df.groupBy(*group).agg(*each)


def paired_cells(scored: DataFrame, cell: str, question: str, arm: str, proposed: str, other: str) -> DataFrame:
    """Counts of each cell over its questions: both pass, both fail, only one of the two arms passes.

    ``scored`` has one row for each cell, question and arm with a verdict. The
    cell's questions are those of the proposed arm; a question that the other
    arm has no answer for fails the query. Both arms meet in one aggregation on
    (cell, question), so nothing is joined.
    """
    won = lambda a: F.max(F.when(F.col(arm) == a, (F.col("verdict") == "pass").cast("int")))
    both = scored.where(F.col(arm).isin(proposed, other)).groupBy(cell, question).agg(won(proposed).alias("p"), won(other).alias("o")).where("p IS NOT NULL")
    lacking = F.raise_error(F.concat(F.lit(f"arm {other} has no answer for "), F.col(question).cast("string"))).cast("int")
    both = both.withColumn("o", F.coalesce("o", lacking))
    return both.groupBy(cell).agg(
        F.count("*").alias("n_questions"), count_of(F.expr("p = 1 AND o = 1")).alias("both_pass"), count_of(F.expr("p = 0 AND o = 0")).alias("both_fail"),
        count_of(F.expr("p = 0 AND o = 1")).alias("other_only"), count_of(F.expr("p = 1 AND o = 0")).alias("proposed_only"),
    )


def recall_hit(kind: Column, fact: Column, response: Column) -> Column:
    """1 or 0 for a recall turn whose response does or does not hold the fact; -1 for any other turn."""
    return F.when(~kind.eqNullSafe("recall"), -1).when(F.contains(response, fact), 1).otherwise(0)


def fold_dashes(text: Column) -> Column:
    """NFKC with dashes as hyphens; case stays. Texts beyond ASCII go to Python."""
    return F.translate(T.nfkc(text), "‐‑–—－", "-----")


def fact_hits(records: DataFrame, facts: DataFrame, group: str) -> DataFrame:
    """Adds ``hit`` to each fact (group, name, code): a record of its group asks for the name and answers with the code.

    ``records``: group, user_text, response, those of the asking phase.
    """
    r = records.select(F.col(group).alias("_g"), fold_dashes(F.col("user_text")).alias("_user"), fold_dashes(F.col("response")).alias("_said"))
    f = facts.distinct().withColumn("_name", fold_dashes(F.col("name"))).withColumn("_code", fold_dashes(F.col("code")))
    on = (F.col(group) == F.col("_g")) & F.contains("_user", F.col("_name")) & F.contains("_said", F.col("_code"))
    return f.join(r, on, "left_semi").select(*facts.columns, F.lit(True).alias("hit")).unionByName(f.join(r, on, "left_anti").select(*facts.columns, F.lit(False).alias("hit")))
