"""Checks on runs and their inputs: rows pass unchanged, or the query fails and says why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what must not be found in an answer that a judge is to see blind.
LEAK = r"\[PN\d+(?:\.\d+)?\]|</?CONTEXT>|\bmass=\S+"


def _said(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])


def require(rows: DataFrame, *rules: tuple[Column, Column]) -> DataFrame:
    """The rows, if every (condition, message) holds for each; the first broken one fails the query, null is broken."""
    broken = F.lit(None).cast("string")
    for ok, message in reversed(rules):
        broken = F.when(F.coalesce(ok, F.lit(False)), broken).otherwise(message)
    return rows.withColumn("_broken", broken).where(F.when(F.col("_broken").isNull(), F.lit(True)).otherwise(F.raise_error(F.col("_broken")).cast("boolean"))).drop("_broken")


def tree_artifact(trees: DataFrame, session_sha: str, round_trips: int | None = None, allow_partial: bool = False) -> DataFrame:
    """Trees (path, n_nodes, session_sha256, turns, stopped) built from this session, not empty and, unless allowed, whole."""
    at = F.col("path")
    rules = [(F.col("n_nodes") > 0, _said(at, ": no nodes")), (F.col("session_sha256") == session_sha, _said(at, ": built from another session, ", F.col("session_sha256")))]
    if round_trips is not None and not allow_partial:
        rules += [(F.col("stopped").isNull(), _said(at, ": partial, stopped at ", F.col("stopped"))), (F.col("turns") == round_trips, _said(at, ": covers ", F.col("turns"), f" round trips of {round_trips}"))]
    return require(trees, *rules)


def compaction_artifact(compactions: DataFrame, expected: dict) -> DataFrame:
    """Compactions (path, budget_question, the expected fields) made for this run; a missing value counts as another."""
    rules = [(F.col(k) == F.lit(v), _said(F.col("path"), f": {k} is ", F.col(k), f", here {v}")) for k, v in expected.items()]
    return require(compactions, *rules, (F.col("budget_question").isNotNull(), _said(F.col("path"), ": no budget question")))


def compaction_window(windows: DataFrame) -> DataFrame:
    """Windows (n_recent, recent: array) that keep all round trips which the compaction calls recent."""
    return require(windows, (F.col("n_recent") == F.size("recent"), _said("the window keeps ", F.col("n_recent"), " round trips, the compaction ", F.size("recent"))))


def answered(rows: DataFrame) -> DataFrame:
    """Answered questions (qid, arm, w, inject, window, planet_lines, prompt_tokens, planet_spans) that fit their window and met their tree.

    With an injected arm every sub-topic line of the window must have been
    found, and at least one where the weight is above 0. A null window has no
    limit.
    """
    q, injected = F.col("qid"), (F.col("arm") == "proposed") & (F.col("inject") != "none")
    return require(
        rows,
        (F.col("window").isNull() | (F.col("prompt_tokens") <= F.col("window")), _said(q, ": ", F.col("prompt_tokens"), " tokens in a window of ", F.col("window"))),
        (~injected | (F.col("planet_spans") == F.col("planet_lines")), _said(q, ": ", F.col("planet_spans"), " spans of ", F.col("planet_lines"), " lines")),
        (~injected | (F.col("w") <= 0) | (F.col("planet_spans") > 0), _said(q, ": nothing to inject into")),
    )


def counters(rows: DataFrame, expected: Column) -> DataFrame:
    """Rows (qid, completion_tokens, decode_forwards, the counters) whose counters are those of the struct ``expected``; a null one counts as 0."""
    decodes = F.greatest(F.col("completion_tokens") - 1, F.lit(0))
    fields = rows.select(expected.alias("e")).schema["e"].dataType.names
    rules = [(F.col("decode_forwards") == decodes, _said(F.col("qid"), ": ", F.col("decode_forwards"), " decode forwards, expected ", decodes))]
    rules += [(F.coalesce(F.col(f), F.lit(0)) == expected[f], _said(F.col("qid"), f": {f} is ", F.coalesce(F.col(f), F.lit(0)), ", expected ", expected[f])) for f in fields]
    return require(rows, *rules)


def cells(rows: DataFrame, text_only: list[str]) -> DataFrame:
    """Cells (arm, w) that mean what their names say: arms whose every line has a mass take no weight."""
    return require(rows, ((F.col("w") <= 0) | ~F.col("arm").isin(text_only), _said("arm ", F.col("arm"), " is text alone and takes no weight, here ", F.col("w"))))


def outside_corpus(facts: DataFrame, excluded: list[int]) -> DataFrame:
    """(id, places) of the facts (id, rt, history: array of places) that rest on an excluded round trip; their own place first."""
    places = F.concat(F.array(F.col("rt").cast("int")), F.coalesce(F.col("history").cast("array<int>"), F.array().cast("array<int>")))
    return facts.select("id", F.filter(places, lambda p: p.isin(excluded)).alias("places")).where(F.size("places") > 0)


def leaks(rows: DataFrame, text: str) -> DataFrame:
    """The rows whose text shows a marker, a context tag or a mass; null shows none."""
    return rows.where(F.col(text).rlike(LEAK))
