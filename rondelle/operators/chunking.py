"""Texts into chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.text import CUT, JA_CONNECTIVES, cut_pieces, estimate_tokens, split_units, strip

SHORT = 12


def meaning_units(text: Column, max_tokens: int = 200) -> Column:
    """Cut before connectives; then over-long pieces at sentence marks; then every 4 * max_tokens characters."""
    ja = "|".join(JA_CONNECTIVES)
    first = cut_pieces(F.regexp_replace(strip(text), f"(?<!^)(?=(?:{ja})[、,])", CUT))
    whole = F.flatten(F.transform(first, lambda u: F.when(estimate_tokens(u) <= max_tokens, F.array(u)).otherwise(cut_pieces(F.regexp_replace(u, "(?<=[。！？!?])", CUT)))))
    size = 4 * max_tokens
    hard = F.flatten(F.transform(whole, lambda u: F.transform(F.sequence(F.lit(0), F.floor((F.length(u) - 1) / size).cast("int")), lambda i: strip(F.substring(u, i * size + 1, F.lit(size))))))
    return F.filter(hard, lambda p: p != "")


def glue_short(chunks: Column, short: int = SHORT) -> Column:
    """Each chunk shorter than ``short`` joined to the one before it (which may have grown already)."""
    merged = F.aggregate(chunks, F.array().cast("array<string>"), lambda acc, c: F.when((F.size(acc) > 0) & (F.length(c) < short), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), c)))).otherwise(F.concat(acc, F.array(c))))
    return merged


def chunk_round_trips(trips: DataFrame, max_tokens: int = 200) -> DataFrame:
    """conv_id, round_trip, source, seq, text: chunks of the user side, then of the assistant side."""
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.lit(name).alias("source"), glue_short(meaning_units(F.col(f"{name}_text"), max_tokens)).alias("chunks")) for i, name in enumerate(("user", "assistant"))])
    each = trips.select("conv_id", "round_trip", F.explode(sides).alias("s"))
    return each.select("conv_id", "round_trip", "s.source", F.posexplode("s.chunks").alias("seq", "text")).select("conv_id", "round_trip", "source", F.col("seq").cast("bigint").alias("seq"), "text")


def hard_split(unit: str, most: int) -> list[str]:
    """An over-long unit, cut at the last space before each limit, else at the limit."""
    out = []
    while len(unit) > most:
        at = unit.rfind(" ", 0, most)
        at = at if at > 0 else most
        out.append(unit[:at].strip())
        unit = unit[at:].strip()
    return [p for p in [*out, unit] if p]


def join_candidates(units: list[str], most: int) -> list[str]:
    """Pieces of at most ``most`` characters; a short chunk takes the next piece in, without a space between CJK neighbours."""
    out: list[str] = []
    for piece in (p for u in units for p in hard_split(u, most)):
        last = out[-1] if out else ""
        if last and len(last) < SHORT and len(last) + 1 + len(piece) <= most:
            wide = ord(last[-1]) > 0x2E80 and ord(piece[0]) > 0x2E80
            out[-1] = f"{last}{'' if wide else ' '}{piece}"
        else:
            out.append(piece)
    return out


def candidates(df: DataFrame, text: str, most: int = 800, into: str = "chunks") -> DataFrame:
    """Adds an array of chunk candidates: units cut in SQL, the length-dependent fold in Arrow batches."""
    if most <= 0:
        raise ValueError("most must be positive")
    schema = StructType([*df.schema.fields, StructField(into, ArrayType(StringType()))])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[into] = [join_candidates(list(u) if u is not None else [], most) for u in b[into]]
            yield b

    return df.withColumn(into, split_units(F.coalesce(F.col(text), F.lit("")))).mapInPandas(fold, schema)


def windows(text: Column, size: int = 30, step: int = 5) -> Column:
    """Overlapping windows of ``size`` characters, ``step`` apart; a shorter text is one window."""
    last = F.greatest(F.lit(1), F.length(text) - size + 1) - 1
    return F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.substring(text, i + 1, F.lit(size)))


def drop_contained(spans: Column) -> Column:
    """Longest first; a span that contains or is contained in a kept one goes."""
    ordered = F.array_sort(spans, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.aggregate(ordered, F.array().cast("array<string>"), lambda acc, s: F.when(F.exists(acc, lambda k: F.contains(k, s) | F.contains(s, k)), acc).otherwise(F.concat(acc, F.array(s))))
