"""Column functions over numbers and vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: Attention layers, heads and head size of the reader that the cost formulas are for.
LAYERS, HEADS, HEAD_DIM = 16, 24, 256


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def attention_flops_prefill(tokens: Column) -> Column:
    return F.lit(LAYERS * 2 * HEADS * HEAD_DIM).cast("bigint") * tokens * tokens


def attention_flops_decode(prompt: Column, completion: Column) -> Column:
    """Sum over t = 1 .. completion - 1 of the cost of one row of prompt + t."""
    n = F.greatest(completion - 1, F.lit(0))
    return F.lit(LAYERS * 2 * HEADS * HEAD_DIM).cast("bigint") * (n * prompt + (n * (n + 1) / 2).cast("bigint"))


def prefill_forwards(prompt: Column, chunk: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(prompt / chunk)).cast("bigint")


def effective_prefill_chunk(prompt: Column, chunk: int) -> Column:
    """One more when the last chunk would be a single row."""
    return F.when(prompt % chunk == 1, F.lit(chunk + 1)).otherwise(F.lit(chunk)).cast("bigint")


def kv_cache_bytes(tokens: Column, layers: int, kv_heads: int, head_dim: int) -> Column:
    return F.lit(2 * layers * kv_heads * head_dim * 2).cast("bigint") * tokens


def cost_usd(tokens: Column, per_million: float) -> Column:
    return tokens * F.lit(per_million) / 1e6


def concentration(p: Column, n: Column) -> Column:
    """Not a function of rows but of aggregates: entropy ``p`` and count ``n``."""
    return F.greatest(F.lit(0.0), 1 - p / F.when(n > 1, F.log(n)).otherwise(1.0))


def binomial_tail(least: int, n: int) -> float:
    """P(X >= least) for n fair coins: the terms from the first one on by their ratios, in logarithms."""
    import numpy as np

    if n == 0 or least <= 0:
        return 1.0
    if 2 * least <= n:  # the shorter tail is the other one
        return 1.0 - binomial_tail(n - least + 1, n)
    first = math.lgamma(n + 1) - math.lgamma(least + 1) - math.lgamma(n - least + 1) - n * math.log(2)
    k = np.arange(least, n)
    logs = np.concatenate([[0.0], np.cumsum(np.log((n - k) / (k + 1)))])
    return float(min(1.0, math.exp(first) * np.exp(logs).sum()))


@pandas_udf(DoubleType())
def mcnemar_one_sided(b, c):
    """Exact P(X >= c) for c of b + c discordant pairs at one half; 1 without pairs."""
    import pandas as pd

    return pd.Series([binomial_tail(int(y), int(x) + int(y)) for x, y in zip(b, c, strict=True)])


def kappa(both: Column, only_a: Column, only_b: Column, neither: Column) -> Column:
    n = both + only_a + only_b + neither
    agree = (both + neither) / n
    chance = ((both + only_a) * (both + only_b) + (neither + only_a) * (neither + only_b)) / (n * n)
    return F.when((n == 0) | (chance == 1), F.lit(0.0)).otherwise((agree - chance) / (1 - chance))
