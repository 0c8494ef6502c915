"""Power samples to energy: trapezoids, clipped to spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seconds(at: str):
    """Seconds since 1970 of a timestamp column or expression, as read off its clock."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', CAST({at} AS TIMESTAMP_NTZ)) / 1e6D")


def segments(samples: DataFrame, group: str, at: str, watts: str) -> DataFrame:
    """(group, t0, p0, t1, p1) between neighbouring samples, times in seconds."""
    w = W.partitionBy(group).orderBy("t0", "p0")
    s = samples.select(group, seconds(at).alias("t0"), F.col(watts).cast("double").alias("p0"))
    return s.withColumn("t1", F.lead("t0").over(w)).withColumn("p1", F.lead("p0").over(w)).where("t1 IS NOT NULL")


def energy_of_spans(samples: DataFrame, spans: DataFrame, group: str, at: str, watts: str) -> DataFrame:
    """Joules of each span (group, span_id, start, stop in seconds): ends are interpolated, a span not covered by samples is null."""
    seg = segments(samples, group, at, watts).withColumnRenamed(group, "_g")
    cover = seg.groupBy("_g").agg(F.min("t0").alias("_a"), F.max("t1").alias("_b"))
    # the group is the join key; a segment belongs to a span if they overlap
    parts = spans.join(seg, (F.col(group) == F.col("_g")) & (F.col("t1") > F.col("start")) & (F.col("t0") < F.col("stop")))
    a, b = F.greatest("t0", "start"), F.least("t1", "stop")
    slope = (F.col("p1") - F.col("p0")) / (F.col("t1") - F.col("t0"))
    joules = (F.col("p0") + slope * (a - F.col("t0")) + F.col("p0") + slope * (b - F.col("t0"))) / 2 * (b - a)
    total = parts.groupBy(group, "span_id").agg(F.sum(joules).alias("_j"))
    out = spans.join(total, [group, "span_id"], "left").join(cover.withColumnRenamed("_g", "_g2"), F.col(group) == F.col("_g2"), "left")
    return out.select(group, "span_id", F.when((F.col("_a") <= F.col("start")) & (F.col("_b") >= F.col("stop")), F.col("_j")).alias("joules"))


def energy_summary(samples: DataFrame, group: str, at: str, watts: str) -> DataFrame:
    """Joules over all samples of a group (0 under two), mean and peak power."""
    seg = segments(samples, group, at, watts).groupBy(group).agg(F.sum((F.col("p0") + F.col("p1")) / 2 * (F.col("t1") - F.col("t0"))).alias("_j"))
    base = samples.groupBy(group).agg(F.count("*").alias("samples"), F.avg(watts).alias("mean_watts"), F.max(watts).alias("peak_watts"))
    return base.join(seg, group, "left").select(group, "samples", F.coalesce("_j", F.lit(0.0)).alias("joules"), "mean_watts", "peak_watts")


def coverage(samples: DataFrame, spans: DataFrame, group: str, at: str) -> DataFrame:
    """Whether a group's samples begin before its first span and end after its last."""
    s = samples.groupBy(group).agg(seconds(f"min({at})").alias("first_sample"), seconds(f"max({at})").alias("last_sample"))
    p = spans.groupBy(group).agg(F.min("start").alias("first_start"), F.max("stop").alias("last_stop"))
    return p.join(s, group, "left").select(group, F.coalesce((F.col("first_sample") <= F.col("first_start")) & (F.col("last_sample") >= F.col("last_stop")), F.lit(False)).alias("covered"))
