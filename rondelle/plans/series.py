"""Queries over time series: energy, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import energy
from .registry import query, table

SEGMENTS = """
s AS (SELECT user_id, epoch_us(ts) / 1e6 AS t0, value AS p0, lead(epoch_us(ts) / 1e6) OVER w AS t1, lead(value) OVER w AS p1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, value)),
g AS (SELECT * FROM s WHERE t1 IS NOT NULL),
sp AS (SELECT user_id, k AS span_id, a + (b - a) * k / 4 + 0.5 AS start, a + (b - a) * (k + 1) / 4 + CASE WHEN k = 3 THEN 1 ELSE 0 END AS stop FROM (SELECT user_id, epoch_us(min(ts)) / 1e6 AS a, epoch_us(max(ts)) / 1e6 AS b FROM events GROUP BY user_id), (SELECT unnest([0, 1, 2, 3]) AS k))
"""


def _spans(events):
    """Quarters of each user's time; the last reaches past the samples."""
    b = events.groupBy("user_id").agg(energy.seconds("min(ts)").alias("a"), energy.seconds("max(ts)").alias("b"))
    k = F.explode(F.array(*map(F.lit, range(4)))).alias("span_id")
    return b.select("user_id", "a", "b", k).select("user_id", "span_id", (F.col("a") + (F.col("b") - F.col("a")) * F.col("span_id") / 4 + 0.5).alias("start"), (F.col("a") + (F.col("b") - F.col("a")) * (F.col("span_id") + 1) / 4 + F.when(F.col("span_id") == 3, 1).otherwise(0)).alias("stop"))


@query("WITH" + SEGMENTS + """, j AS (SELECT sp.user_id, span_id, start, stop, greatest(t0, start) AS a, least(t1, stop) AS b, t0, p0, (p1 - p0) / (t1 - t0) AS m FROM sp JOIN g ON sp.user_id = g.user_id AND t1 > start AND t0 < stop),
t AS (SELECT user_id, span_id, sum((2 * p0 + m * (a - t0) + m * (b - t0)) / 2 * (b - a)) AS j FROM j GROUP BY user_id, span_id), c AS (SELECT user_id, min(t0) AS a, max(t1) AS b FROM g GROUP BY user_id)
SELECT sp.user_id, sp.span_id, round(CASE WHEN c.a <= start AND c.b >= stop THEN t.j END, 3) AS joules FROM sp LEFT JOIN t ON sp.user_id = t.user_id AND sp.span_id = t.span_id LEFT JOIN c ON sp.user_id = c.user_id""")  # fmt: skip
def energy_per_span(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    return energy.energy_of_spans(e, _spans(e), "user_id", "ts", "value").select("user_id", "span_id", F.round("joules", 3).alias("joules"))


@query("WITH" + SEGMENTS + """SELECT e.user_id, e.samples, round(coalesce(j, 0), 3) AS joules, round(mean_watts, 6) AS mean_watts, peak_watts FROM (SELECT user_id, count(*) AS samples, avg(value) AS mean_watts, max(value) AS peak_watts FROM events GROUP BY user_id) e
LEFT JOIN (SELECT user_id, sum((p0 + p1) / 2 * (t1 - t0)) AS j FROM g GROUP BY user_id) t ON e.user_id = t.user_id""")  # fmt: skip
def energy_summary(spark, sf_dir):
    out = energy.energy_summary(table(spark, sf_dir, "events").select("user_id", "ts", "value"), "user_id", "ts", "value")
    return out.select("user_id", "samples", F.round("joules", 3).alias("joules"), F.round("mean_watts", 6).alias("mean_watts"), "peak_watts")


@query("WITH" + SEGMENTS + "SELECT sp.user_id, coalesce(min(c.a) <= min(start) AND max(c.b) >= max(stop), false) AS covered FROM sp LEFT JOIN (SELECT user_id, epoch_us(min(ts)) / 1e6 AS a, epoch_us(max(ts)) / 1e6 AS b FROM events GROUP BY user_id) c ON sp.user_id = c.user_id GROUP BY sp.user_id")
def energy_coverage(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    return energy.coverage(e, _spans(e), "user_id", "ts")
