"""Multiple choice and typed answers."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

LETTERS = "ABCD"


@F.pandas_udf(ArrayType(StringType()))
def _in_hash_order(ids: pd.Series, options: pd.Series) -> pd.Series:
    """Options by the hash of the question's number and the option; the number is the id's digest, too long for a Spark type."""

    def order(qid, some):
        seed = int(hashlib.sha256((qid or "").encode()).hexdigest(), 16)
        return sorted(some, key=lambda o: hashlib.sha256(f"{seed}:{o}".encode()).hexdigest())

    return pd.Series([order(q, o) for q, o in zip(ids, options, strict=True)], dtype=object)


def shuffled_options(qid: Column, correct: Column, incorrect: Column) -> Column:
    """The right answer among the wrong ones, in an order that depends on the question's id alone."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    wrong = F.coalesce(incorrect, F.array().cast("array<string>"))
    return _in_hash_order(qid, F.concat(F.array(blank(correct)), F.transform(wrong, blank)))


def correct_letter(options: Column, correct: Column) -> Column:
    """Letter of the right answer's first place; null beyond D."""
    at = F.array_position(options, F.coalesce(correct, F.lit(""))).cast("int")
    return F.when((at > 0) & (at <= len(LETTERS)), F.substring(F.lit(LETTERS), at, F.lit(1)))


def option_lines(options: Column) -> Column:
    """Lines "A. text" of up to four options."""
    letters = F.array(*[F.lit(x) for x in LETTERS])
    return F.array_join(F.transform(F.slice(options, 1, len(LETTERS)), lambda o, i: F.concat(F.get(letters, i), F.lit(". "), F.trim(o))), "\n")


def wrong_answers(value: Column) -> Column:
    """The strings of a JSON list; empty for null, and for anything that is not a list."""
    return F.when(F.coalesce(value, F.lit("")).rlike(r"^\s*\["), F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def _stop(why: str) -> Column:
    return F.raise_error(F.lit(why))


def chosen(kind: Column, choice: Column, probabilities: Column, offered: Column | None = None) -> Column:
    """The option of a choice answer. The query fails on an answer of another kind, an option not offered, or bad probabilities.

    Probabilities (a map, null for none) are checked and never decide.
    """
    ps = F.map_values(probabilities)
    bad = F.exists(ps, lambda p: p.isNull() | F.isnan(p) | (p < 0) | (p > 1)) | ~F.exists(ps, lambda p: p > 0)
    foreign = F.lit(False) if offered is None else ~F.array_contains(offered, choice) | F.coalesce(F.exists(F.map_keys(probabilities), lambda k: ~F.array_contains(offered, k)), F.lit(False))
    return (
        F.when(~kind.eqNullSafe("choice"), _stop("not a choice answer").cast("string")).when(F.coalesce(choice, F.lit("")) == "", _stop("no choice").cast("string"))
        .when(foreign, _stop("not an offered option").cast("string")).when(F.coalesce(bad, F.lit(False)), _stop("bad probabilities").cast("string")).otherwise(choice)
    )


def probability(kind: Column, value: Column, wanted: str = "noul") -> Column:
    """The number of a typed answer; the query fails on another kind or a number that is no probability."""
    sound = value.isNotNull() & ~F.isnan(value) & value.between(0, 1)
    return F.when(~kind.eqNullSafe(wanted), _stop(f"not a {wanted} answer").cast("double")).when(~sound, _stop("not a probability").cast("double")).otherwise(value)
