"""Rendered trees read back: lines, spans, and per-position weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A marker and the text behind it: [SN], [RN] or [PN<mass>].
MARKER = r"\[(?:SN|RN|PN ?([0-9.]*))\]"


def block_lines(blocks: DataFrame, block: str = "block") -> DataFrame:
    """One row per marked line of a context block: its other columns, pos, level (leading spaces // 2, 2 at most), marker, mass, text."""
    lines = blocks.select(*[c for c in blocks.columns if c != block], F.posexplode(F.split(block, "\n")).alias("pos", "_line")).where(F.col("_line").rlike(rf"^ *{MARKER}"))
    level = F.least(F.lit(2), F.floor(F.length(F.regexp_extract("_line", "^( *)", 1)) / 2).cast("int"))
    mass = F.expr(r"try_cast(nullif(regexp_extract(_line, '\\[PN ?([0-9.]*)\\]', 1), '') AS DOUBLE)")
    return lines.select(*[c for c in lines.columns if c not in ("_line",)], level.alias("level"), F.regexp_extract("_line", r"\[(SN|PN|RN)", 1).alias("marker"), mass.alias("mass"), F.regexp_replace("_line", rf"^ *{MARKER} ?", "").alias("text"))


def inherited_mass(lines: DataFrame, group: str, reset: bool = True) -> DataFrame:
    """Adds ``carried``: a sub-topic's own mass, and for a detail that of the last sub-topic before it.

    With ``reset`` a topic in between ends the inheritance; without, it does not.
    """
    order = W.partitionBy(group).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    run = F.sum((F.col("level") == 0).cast("int")).over(order) if reset else F.lit(0)
    n = lines.withColumn("_run", run)
    w = W.partitionBy(group, "_run").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("level") == 1, F.col("mass")), ignorenulls=True).over(w)
    return n.withColumn("carried", F.when(F.col("level") == 1, F.col("mass")).when(F.col("level") == 2, last)).drop("_run")


def mass_vector(positions: DataFrame, group: str, pos: str, mass: str, length: str, cap: float, scale: float = 1.0) -> DataFrame:
    """Dense vector of each group: min(cap, mass * scale) at its positions, the larger one where two meet, 0 elsewhere.

    Positions outside the length are left out; a group without any left has none.
    """
    inside = positions.where((F.col(pos) >= 0) & (F.col(pos) < F.col(length)) & (F.col(mass) > 0))
    best = inside.groupBy(group, pos).agg(F.max(F.least(F.lit(cap), F.col(mass) * scale)).alias("_m"), F.max(length).alias("_n"))
    packed = best.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct(F.col(pos).cast("int"), "_m"))).alias("_at"), F.max("_n").cast("int").alias("_n"))
    return packed.select(group, F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.coalesce(F.try_element_at("_at", i), F.lit(0.0))).alias("vector"))


def mass_bias(vector: Column, weight: float, cap: float, keys: Column) -> Column:
    """Additive attention bias of one query row: min(cap, weight * mass), cut or filled with zeros to ``keys`` positions."""
    cut = F.transform(F.slice(vector, 1, keys), lambda m: F.least(F.lit(cap), m * weight))
    return F.concat(cut, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), keys - F.size(vector))))


def causal_row(query: Column, queries: Column, keys: Column) -> Column:
    """Which keys a query sees when both ends are aligned."""
    return F.transform(F.sequence(F.lit(0), keys - 1), lambda k: k <= query + keys - queries)


#: Fixed value: the lowest finite number of a 32-bit float, which masks a key.
LOWEST = -3.4028234663852886e38


def combined_mask(bias: Column, allowed: Column | None = None, added: Column | None = None) -> Column:
    """One query row's mask with the mass bias: a boolean mask (false: masked) or a float one, neither for none.

    Lengths must agree, or the query fails. Masked keys stay finite, so that a
    row with no key left is no NaN; sums below the lowest float stay there.
    """
    if allowed is None and added is None:
        return bias
    other = F.transform(allowed, lambda a: F.when(a, F.lit(0.0)).otherwise(F.lit(LOWEST))) if added is None else added
    said = F.concat(F.lit("bias and mask differ in length: "), F.size(bias).cast("string"), F.lit(" and "), F.size(other).cast("string"))
    both = F.zip_with(other, bias, lambda m, b: F.greatest(F.lit(LOWEST), m + b))
    return F.when(F.size(bias) == F.size(other), both).otherwise(F.raise_error(said).cast("array<double>"))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, v: a + v))


def mass_share(probabilities: DataFrame, group: str, value: str, chosen: str) -> DataFrame:
    """Share of a group's probability on the chosen rows."""
    return probabilities.groupBy(group).agg((F.sum(F.when(F.col(chosen), F.col(value)).otherwise(0.0)) / F.sum(value)).alias("share"))


def largest_sub_mass(block: Column) -> Column:
    return F.array_max(F.transform(F.regexp_extract_all(block, F.lit(r"\[PN ?([0-9.]+)\]"), 1), lambda x: x.try_cast("double")))
