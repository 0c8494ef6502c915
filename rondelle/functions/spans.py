"""Marked concepts in a prompt that is cut into tokens: which tokens each marker speaks of, and their masses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .markers import inherited_mass

#: Whole markers, and how one begins, with and without marks of the levels.
WHOLE = {False: r"\[PN[0-9.]+\]", True: r"\[(?:SN|RN|PN[0-9.]+)\]"}
BEGUN = {False: r"\[PN", True: r"\[[SPR]N"}


def _blank(text: Column) -> Column:
    return text.rlike(r"(?U)^\s*$")


def token_spans(prompts: DataFrame, pieces: str = "pieces", level_markers: bool = False) -> DataFrame:
    """One row for each marker of a prompt: the other columns, span (from 0), level, mass, positions.

    ``pieces`` are the texts of a prompt's tokens in order. A marker's concept
    runs to the next line break or the next marker, and its positions are the
    tokens with a part of it. A token that also holds other text counts only if
    its part is not blank; one in which the next marker begins counts only if
    the concept began in it too. With ``level_markers`` the marker names the
    level and only sub-topics have a mass (0 elsewhere); else the level is that
    of the line's leading spaces. A prompt without markers, null or empty, has
    no row. A prompt is one row, so its tokens are bounded by a model's window.
    """
    keys = [c for c in prompts.columns if c != pieces]
    p = prompts.select(*keys, F.transform(F.coalesce(pieces, F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit(""))).alias("_p"))
    p = p.withColumn("_text", F.array_join("_p", "")).withColumn("_owner", F.flatten(F.transform("_p", lambda t, i: F.array_repeat(i, F.length(t)))))
    whole = WHOLE[level_markers]
    p = p.withColumn("_marks", F.regexp_extract_all("_text", F.lit(f"({whole})"), 1)).withColumn("_between", F.split("_text", whole))
    # lengths of text up to and with each marker; a prompt has few markers beside its tokens
    n = F.size("_marks")
    p = p.withColumn("_steps", F.zip_with("_marks", F.slice("_between", 1, n), lambda m, b: F.length(m) + F.length(b)))
    each = F.zip_with("_marks", F.slice("_between", 2, n), lambda m, b: F.struct(m.alias("mark"), b.alias("rest")))
    s = p.select(*keys, "_text", "_owner", "_steps", F.posexplode(each).alias("span", "_s"))
    start = F.aggregate(F.slice("_steps", 1, F.col("span") + 1), F.lit(0), lambda total, k: total + k)
    s = s.select(*keys, "span", "_text", "_owner", start.alias("start"), "_s.*")

    # the concept, and whether a marker ends it (else a line break or the end of the text)
    s = s.withColumn("_said", F.regexp_extract("rest", rf"^(?:(?!{BEGUN[level_markers]})[^\n])*", 0)).withColumn("_n", F.length("_said"))
    after = F.substr("_text", F.col("start") + F.col("_n") + 1, F.lit(1))
    s = s.withColumn("_by_marker", after == "[")
    own = F.slice("_owner", F.col("start") + 1, F.col("_n"))
    s = s.withColumn("_own", own).withColumn("_first", F.get("_own", 0)).withColumn("_last", F.get("_own", F.col("_n") - 1))
    of = lambda which: F.size(F.filter("_own", lambda o: o == F.col(which)))
    opening = F.get("_owner", F.col("start") - 1) == F.col("_first")
    closing = F.coalesce(F.get("_owner", F.col("start") + F.col("_n")) == F.col("_last"), F.lit(False))
    no_first = opening & _blank(F.substr("_said", F.lit(1), of("_first")))
    in_one = opening & (F.col("_first") == F.col("_last"))
    no_last = closing & (F.col("_by_marker") & ~in_one | _blank(F.substr("_said", F.col("_n") - of("_last") + 1, of("_last"))))
    # a concept's tokens follow each other: only the ends can go, so no token is looked at for another's sake
    low = F.col("_first") + F.coalesce(no_first.cast("int"), F.lit(0))
    high = F.col("_last") - F.coalesce(no_last.cast("int"), F.lit(0))
    s = s.withColumn("_low", low).withColumn("_high", high)
    positions = F.when(F.col("_low") <= F.col("_high"), F.sequence("_low", "_high")).otherwise(F.array().cast("array<int>"))

    told = F.regexp_extract("mark", r"\[PN([0-9.]+)\]", 1).try_cast("double")
    if level_markers:
        kind = F.substr("mark", F.lit(2), F.lit(1))
        level, mass = F.when(kind == "S", 0).when(kind == "P", 1).otherwise(2), F.when(kind == "P", told).otherwise(0.0)
    else:
        line = F.substring_index(F.substr("_text", F.lit(1), F.col("start") - F.length("mark")), "\n", -1)
        level, mass = F.least(F.lit(2), F.floor(F.length(F.regexp_extract(line, "^( *)", 1)) / 2).cast("int")), told
    return s.select(*keys, "span", level.alias("level"), mass.alias("mass"), positions.alias("positions"))


def positions(spans: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """A row for each position of the spans of the given levels (all, if none are given), with its span's columns."""
    kept = spans.where(F.col("level").isin(levels)) if levels else spans
    return kept.select(*[c for c in spans.columns if c != "positions"], F.explode("positions").alias("position"))


def weighted_positions(spans: DataFrame, group: str, levels: list[int] | None = None, inherit: bool = False) -> DataFrame:
    """group, position, mass of the spans of the given levels (sub-topics, if none are given) that have a mass.

    With ``inherit`` details take the mass of the last sub-topic before them
    under the same topic, and count whatever the levels. Topics have no mass.
    """
    wanted = F.col("level").isin(levels or [1])
    order = spans.select(group, F.col("span").alias("pos"), "level", "mass", "positions")
    if inherit:
        order = inherited_mass(order, group)
        mass, wanted = F.when(F.col("level") > 0, F.col("carried")), wanted | (F.col("level") == 2)
    else:
        mass = F.when(F.col("level") > 0, F.col("mass"))
    return order.withColumn("mass", mass).where(wanted & (F.col("mass") > 0)).select(group, F.explode("positions").alias("position"), "mass")


def with_levels(spans: DataFrame, levels: DataFrame, group: str) -> DataFrame:
    """The spans with the levels (group, span, level) read from the block itself; where counts differ the query fails."""
    named = levels.select(group, "span", F.col("level").alias("_level"), F.lit(True).alias("_there"))
    both = spans.drop("level").withColumn("_here", F.lit(True)).join(named, [group, "span"], "full")
    said = F.concat(F.lit("spans and levels differ in number: "), F.col(group).cast("string"))
    both = both.withColumn("level", F.when(F.col("_here") & F.col("_there"), F.col("_level")).otherwise(F.raise_error(said).cast("int")))
    return both.select(*spans.columns)
