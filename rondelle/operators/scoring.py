"""Answers against gold facts, and statistics over verdicts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numeric import kappa, mcnemar_one_sided


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


#: Separators inside folded candidates: of the parts of one, and of candidates.
PART, CANDIDATE = "\x1e", "\x1d"


def matches(candidate: Column, hay: Column, hay_decimal: Column) -> Column:
    """One folded candidate against a normalised answer: all of its parts, short ones as whole tokens."""

    def simple(part: Column) -> Column:
        def test(exact: Column) -> Column:
            token = F.concat(F.lit(r"(?U)(?<![\w.])\Q"), exact, F.lit(r"\E(?![\w.])"))
            return F.when(exact == "", F.lit(False)).when(T.is_short_needle(exact), F.rlike(hay_decimal, token)).otherwise(_let(T.number_words_to_digits(T.normalise_folded(part)), lambda n: (n != "") & F.contains(hay, n)))

        return _let(T.number_words_to_digits(T.keep_decimal_folded(part)), test)

    parts = F.filter(F.split(candidate, PART), lambda p: F.trim(p) != "")
    return F.when(F.contains(candidate, F.lit(PART)), (F.size(parts) > 0) & F.forall(parts, simple)).otherwise(simple(candidate))


def tier1(df: DataFrame, gold: str, aliases: str, answer: str) -> DataFrame:
    """Adds ``passed`` and ``matched_alias`` (null when the gold itself matched).

    An answer that says "not known" passes only if the gold or an alias says so
    too. Gold first, then aliases in their order; a candidate of several parts
    (`` & `` between them) needs them all.
    """
    rows = df.withColumn("_folded", T.lower_nfkc(T.scrub(F.col(answer)))).withColumn("_plain", T.normalise_folded(F.col("_folded")))
    rows = rows.withColumn("_hay", T.number_words_to_digits(F.col("_plain"))).withColumn("_dec", T.number_words_to_digits(T.keep_decimal_folded(F.col("_folded"))))
    # all candidates of a row are folded in one string, as folding cannot be done inside lambdas; a null one matches nothing
    labels = F.coalesce(F.col(aliases), F.array().cast("array<string>"))
    each = F.concat(F.array(F.coalesce(F.col(gold), F.lit(""))), F.transform(labels, lambda a: F.coalesce(a, F.lit(""))))
    joined = F.array_join(F.transform(each, lambda c: F.replace(c, F.lit(" & "), F.lit(PART))), CANDIDATE)
    rows = rows.withColumn("_each", F.split(T.lower_nfkc(joined), CANDIDATE))
    tries = F.zip_with(F.col("_each"), F.concat(F.array(F.lit(None).cast("string")), labels), lambda c, label: F.struct(c.alias("c"), label.alias("label")))
    refused = F.col("_plain").isin(T.REFUSALS)
    same = lambda c: T.normalise_folded(F.replace(c, F.lit(PART), F.lit(" & "))).isin(T.REFUSALS)
    hits = F.filter(tries, lambda t: F.when(refused, same(t["c"])).otherwise(matches(t["c"], F.col("_hay"), F.col("_dec"))))
    rows = rows.withColumn("_hits", F.when(F.col("_hay") != "", hits).otherwise(F.slice(tries, 1, 0)))
    return rows.withColumn("passed", F.size("_hits") > 0).withColumn("matched_alias", F.get("_hits", 0)["label"]).drop("_folded", "_plain", "_hay", "_dec", "_each", "_hits")


def contained(response: Column, gold: Column) -> Column:
    """Normalised gold inside the normalised response; an empty gold never is."""
    said = T.normalise(gold)
    return (said != "") & F.contains(T.normalise(response), said)


def paired(df: DataFrame, a: str, b: str) -> DataFrame:
    """2 x 2 counts of two binary raters, agreement, kappa and the one-sided McNemar p of a over b."""
    n = lambda x, y: F.count(F.when((F.col(a) == x) & (F.col(b) == y), 1))
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(n(1, 1).alias("both"), n(1, 0).alias("only_a"), n(0, 1).alias("only_b"), n(0, 0).alias("neither"))
    k = kappa(*map(F.col, ("both", "only_a", "only_b", "neither")))
    total = F.greatest(F.col("both") + F.col("only_a") + F.col("only_b") + F.col("neither"), F.lit(1))
    return c.select("*", F.round((F.col("both") + F.col("neither")) / total, 6).alias("agreement"), F.round(k, 6).alias("kappa"), F.round(mcnemar_one_sided("only_b", "only_a"), 6).alias("mcnemar_p"))


def bootstrap(df: DataFrame, group: str, a: str, b: str, draws: int = 10_000, alpha: float = 0.05, seed: int = 47) -> DataFrame:
    """Percentile intervals of the difference and the ratio of two paired pass rates.

    Draws in which b never passes have no ratio; if none has one it is null.

    A resample of pairs is a multinomial draw of their four outcomes, so a group
    is four counts whatever its size, and only those reach Python.
    """
    n = lambda x, y, name: F.count(F.when((F.col(a) == x) & (F.col(b) == y), 1)).alias(name)
    counts = df.groupBy(group).agg(n(1, 1, "both"), n(1, 0, "only_a"), n(0, 1, "only_b"), n(0, 0, "neither"))
    kind = counts.schema[group].dataType.simpleString()

    def resample(batches):
        import numpy as np

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                four = np.array([r.both, r.only_a, r.only_b, r.neither], float)
                total = four.sum()
                if not total:
                    continue
                drawn = np.random.default_rng(seed).multinomial(int(total), four / total, draws)
                ends = [100 * alpha / 2, 100 * (1 - alpha / 2)]
                low, high = np.percentile((drawn[:, 1] - drawn[:, 2]) / total, ends)
                told = drawn[drawn[:, 0] + drawn[:, 2] > 0]
                ratio = np.percentile((told[:, 0] + told[:, 1]) / (told[:, 0] + told[:, 2]), ends).tolist() if len(told) else [None, None]
                out.append((getattr(r, group), int(total), (four[1] - four[2]) / total, float(low), float(high), *ratio))
            yield pd.DataFrame(out, columns=[group, "n", "difference", "low", "high", "ratio_low", "ratio_high"])

    return counts.mapInPandas(resample, f"{group} {kind}, n bigint, difference double, low double, high double, ratio_low double, ratio_high double")


def index_percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """For each group and name the element at int(n * share) of its sorted values (not interpolated, nulls aside).

    Different values are counted first, so a group's window passes over its
    different values, one at a time, and no list of values is ever built.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(group).orderBy(value))
    rows = counted.withColumn("_upto", upto).withColumn("_n", F.sum("_c").over(W.partitionBy(group)))
    at = lambda q: F.min(F.when(F.col("_upto") > F.least(F.floor(F.col("_n") * F.lit(q)), F.col("_n") - 1), F.col(value)))
    return rows.groupBy(group).agg(*[at(q).alias(name) for name, q in shares.items()])


def spread(df: DataFrame, group: list[str], value: str, digits: int = 2) -> DataFrame:
    """n, min, max, mean, median, quartiles (interpolated) and sample deviation (0 for one value)."""
    r = lambda c: F.round(c, digits)
    return df.groupBy(*group).agg(
        F.count(value).alias("n"), F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"), r(F.avg(value)).alias("mean"), r(F.percentile(value, F.lit(0.5))).alias("median"),
        r(F.percentile(value, F.lit(0.25))).alias("p25"), r(F.percentile(value, F.lit(0.75))).alias("p75"), r(F.coalesce(F.stddev_samp(value), F.lit(0.0))).alias("sd"),
    )


def correlations(df: DataFrame, binary: str, value: str) -> DataFrame:
    """Pearson r and point-biserial r (sample deviation) of a 0/1 column and a number; null under three rows or without spread."""
    m = lambda x: F.avg(F.when(F.col(binary) == x, F.col(value)))
    n = lambda x: F.count(F.when(F.col(binary) == x, 1))
    c = df.agg(F.count("*").alias("n"), F.corr(binary, value).alias("r"), m(1).alias("m1"), m(0).alias("m0"), n(1).alias("n1"), n(0).alias("n0"), F.stddev_samp(value).alias("sd"))
    ok = (F.col("n") >= 3) & (F.col("sd") > 0)
    return c.select("n", F.when(ok, F.round("r", 6)).alias("pearson"), F.when(ok & (F.col("n1") > 0) & (F.col("n0") > 0), F.round((F.col("m1") - F.col("m0")) / F.col("sd") * F.sqrt(F.col("n1") * F.col("n0") / (F.col("n") * F.col("n"))), 6)).alias("point_biserial"))


def argmax_level(probabilities: Column) -> Column:
    """Key of the largest value of a MAP<INT, DOUBLE>; ties go to the lower key."""
    return F.get(F.array_sort(F.map_entries(probabilities), lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).otherwise(1)), 0)["key"]
