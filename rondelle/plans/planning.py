"""Queries over budgets and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import planning
from .registry import query, table


@query()
def compacted_history(spark, sf_dir):
    return planning.compact(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 800)


@query("""
WITH c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS t, sum(length(text))::BIGINT AS s FROM conversations GROUP BY conv_id),
w AS (SELECT conv_id, max(p * ceil(s_ / 254.0) + (n - s_ - p) * ceil(p / 254.0)) AS within FROM (SELECT conv_id, n, s_, unnest(range(0, n - s_ + 1)) AS p FROM (SELECT conv_id, n, unnest(range(0, n + 1)) AS s_ FROM c)) GROUP BY conv_id)
SELECT c.conv_id, CAST(within AS BIGINT) AS within_turn, CAST(n + within + n * (ceil((t + n + s + n) / 254.0) + ceil((n + n) / 254.0) + ceil((t + n) / 254.0)) AS BIGINT) AS requests FROM c JOIN w USING (conv_id)""")
def request_bounds(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("role") == "user", 1)).alias("t"), F.sum(F.length("text")).cast("bigint").alias("s"))
    n, t, s = F.col("n"), F.col("t"), F.col("s")
    return c.select("conv_id", planning.within_turn_requests(n).alias("within_turn"), planning.projected_requests(n, t, n, s).alias("requests"))


@query("SELECT conv_id, turn, 'r' || lpad(CAST(conv_id AS VARCHAR), 2, '0') || '_' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR), 2, '0') AS qid FROM conversations")
def numbered_items(spark, sf_dir):
    return planning.numbered(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn", "r")


@query("SELECT DISTINCT arm, w, CASE WHEN w = 0 THEN 'none' ELSE inject END AS inject FROM (SELECT unnest(['full', 'cd']) AS arm), (SELECT unnest([0.0, 0.1, 1.0]::DOUBLE[]) AS w), (SELECT unnest(['pn', 'all']) AS inject)")
def run_grid(spark, sf_dir):
    return planning.grid(spark, ["full", "cd"], [0.0, 0.1, 1.0], ["pn", "all"])


@query("SELECT count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS \"both\", count(*) FILTER (l.doc_id IS NULL) AS only_a, count(*) FILTER (d.doc_id IS NULL) AS only_b FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def label_overlap(spark, sf_dir):
    return planning.key_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, source, substr(sha256('s:' || source || ':' || doc_id), 1, 16) AS anonymous_id FROM (SELECT doc_id, 'a' AS source FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'b' FROM labels WHERE toxic = 1)")
def blinded_sets(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return planning.blinded(labels.where("quality = 1").select("doc_id"), labels.where("toxic = 1").select("doc_id"), "doc_id", "s")


@query("""
SELECT source, coalesce(count(*) > 0 AND avg(CASE WHEN quality = 0 THEN 1.0 ELSE 0 END) > 0.15, false) AS stop, avg(quality) - avg(toxic) > 0.75 AS better FROM labels JOIN documents USING (doc_id) GROUP BY source""")
def source_gates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    g = table(spark, sf_dir, "labels").join(docs, "doc_id").groupBy("source").agg(F.count(F.when(F.col("quality") == 0, 1)).alias("bad"), F.count("*").alias("n"), F.avg("quality").alias("q"), F.avg("toxic").alias("t"))
    return g.select("source", planning.ratio_gate(F.col("bad"), F.col("n"), 0.15).alias("stop"), planning.should_replace(F.col("t"), F.col("q"), 0.75).alias("better"))


@query("""
WITH y AS (SELECT user_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
SELECT user_id, bool_and(coalesce(value > p, true)) AS grows, arg_max(value, r) >= 1.5 * arg_min(value, r) AS enough FROM y GROUP BY user_id""")
def user_growth(spark, sf_dir):
    """Growth over all events of each user."""
    from pyspark.sql import Window as W

    each = table(spark, sf_dir, "events").withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return planning.strictly_grows(each, "user_id", "r", "value", 1.5)
