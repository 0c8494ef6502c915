"""SimHash fingerprints in SQL expressions, and permuted block tables over them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ASCII_SPACE

#: Two counters of 32 bits share one 64-bit sum: bit i and bit i + 32.
LANES = "shiftrightunsigned({h}, {i}) & 4294967297L"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.filter(F.split(text, ASCII_SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it.

    A plain column would be written out at each mention, inside lambdas too, and
    so be computed anew for every element.
    """
    return F.get(F.transform(F.array(value), body), 0)


def shingles(text: Column, k: int) -> Column:
    """Runs of k neighbouring words of a text, repeats included; fewer words: the whole sequence; none: empty."""
    return let(words(text), lambda ws: _runs(ws, k))


def _runs(ws: Column, k: int) -> Column:
    some = F.transform(F.sequence(F.lit(0), F.size(ws) - k), lambda i: F.concat_ws(" ", *[F.get(ws, i + j) for j in range(k)]))
    return F.when(F.size(ws) >= k, some).when(F.size(ws) > 0, F.array(F.array_join(ws, " "))).otherwise(F.array().cast("array<string>"))


def vote(df: DataFrame, keys: list[str], h: str, weight: str | None = None) -> DataFrame:
    """One fingerprint for each key from rows of term hashes.

    Each hash votes on 64 bits with its weight (1 by default); a bit is 1 if
    the votes for it are over half. A null hash is no vote; without votes the
    fingerprint is 0. 32 packed sums instead of 64; a counter holds weights of
    up to 2**32 for one text.
    """
    times = f" * CAST({weight} AS BIGINT)" if weight else ""
    sums = [F.expr(f"sum(({LANES.format(h=h, i=i)}){times})").alias(f"_s{i}") for i in range(32)]
    total = F.expr(f"sum(CAST({weight or 1} AS BIGINT)) FILTER (WHERE {h} IS NOT NULL)").alias("_n")
    voted = df.groupBy(*keys).agg(*sums, total)
    low = [f"IF(2 * (_s{i} & 4294967295L) > _n, {1 << i}L, 0L)" for i in range(32)]
    high = [f"IF(2 * shiftrightunsigned(_s{i}, 32) > _n, shiftleft(1L, {i + 32}), 0L)" for i in range(32)]
    halves = voted.select(*keys, F.expr(" | ".join(low)).alias("_lo"), F.expr(" | ".join(high)).alias("_hi"))
    return halves.select(*keys, F.expr("coalesce(_lo, 0L) | coalesce(_hi, 0L)").alias("fp"))


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def blocks_for(rows: int, radius: int) -> int:
    """Number of blocks for so many fingerprints.

    Two fingerprints within the radius differ in at most ``radius`` blocks, so
    they agree in all others, whatever the number of blocks is. More blocks
    make longer keys (fewer candidates) and more tables.
    """
    blocks = radius + 1
    while (64 * (blocks - radius)) // blocks < rows.bit_length() - 2 and blocks < radius + 4:
        blocks += 1
    return blocks


def permutations(radius: int, blocks: int) -> list[tuple[list[tuple[int, int]], int]]:
    """For each choice of blocks that must agree: all bit fields (low end, width), the chosen first, and the key's width."""
    edges = [64 * b // blocks for b in range(blocks + 1)]
    fields = [(edges[b], edges[b + 1] - edges[b]) for b in range(blocks)]
    out = []
    for chosen in combinations(range(blocks), blocks - radius):
        order = [fields[b] for b in chosen] + [fields[b] for b in range(blocks) if b not in chosen]
        out.append((order, sum(fields[b][1] for b in chosen)))
    return out


def permuted(fp: str, order: list[tuple[int, int]]) -> str:
    """SQL of the fingerprint with its bit fields put in that order, from the top."""
    at, parts = 64, []
    for low, width in order:
        at -= width
        parts.append(f"shiftleft(shiftrightunsigned({fp}, {low}) & {(1 << width) - 1}L, {at})")
    return "(" + " | ".join(parts) + ")"


def tables(fps: DataFrame, fp: str, radius: int, blocks: int) -> DataFrame:
    """Each row once for each permuted table: adds table_no, perm (permuted fingerprint) and block (its key part)."""
    each = [F.expr(f"struct({t} AS table_no, {permuted(fp, order)} AS perm, shiftrightunsigned({permuted(fp, order)}, {64 - width}) AS block)") for t, (order, width) in enumerate(permutations(radius, blocks))]
    return fps.select("*", F.explode(F.array(*each)).alias("_t")).select("*", "_t.*").drop("_t")


def within_radius(queries: DataFrame, index: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """All (query_fp, fp) with at most ``radius`` differing bits, each once.

    ``queries`` has distinct ``query_fp``, ``index`` distinct ``fp`` (both
    BIGINT). A pair is a candidate in every table whose key it shares and is
    emitted from the first such table alone, so no distinct is needed.
    """
    if blocks is None:
        blocks = blocks_for(index.count(), radius)
    perms = permutations(radius, blocks)
    left = tables(queries, "query_fp", radius, blocks).select("query_fp", "table_no", "block")
    right = tables(index, "fp", radius, blocks).select("fp", F.col("table_no").alias("_t"), F.col("block").alias("_b"))
    agree = []
    for order, width in perms:
        mask, used = 0, 0
        for low, w in order:
            if used < width:
                mask |= ((1 << w) - 1) << low
                used += w
        agree.append(mask - (1 << 64) if mask >> 63 else mask)
    first = "CASE " + " ".join(f"WHEN (query_fp ^ fp) & CAST('{m}' AS BIGINT) = 0 THEN {t}" for t, m in enumerate(agree)) + " END"
    on = (F.col("table_no") == F.col("_t")) & (F.col("block") == F.col("_b")) & (F.expr("bit_count(query_fp ^ fp)") <= radius) & (F.col("table_no") == F.expr(first))
    return left.join(right, on).select("query_fp", "fp")
