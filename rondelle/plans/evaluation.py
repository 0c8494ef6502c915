"""Queries over answers, labels and vectors: scoring, statistics, matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..operators import dialogue, matching, scoring
from .dialogue import NORMAL, PAIRED, SQUEEZE
from .registry import query, table

#: Questions and answers made from round trips: words of the user's side as golds, the assistant's side as answer.
ASKED = """
w AS (SELECT conv_id, round_trip, list_filter(string_split(user_text, ' '), lambda x: x <> '') AS ws, assistant_text FROM trips),
q AS (SELECT conv_id, round_trip, coalesce(ws[2], '') AS gold, [coalesce(ws[3], 'x9'), coalesce(ws[1], '') || ' & ' || coalesce(ws[4], '')] AS aliases,
        CASE WHEN round_trip % 7 = 6 THEN 'Not mentioned.' ELSE assistant_text END AS answer FROM w)
"""
DECIMAL = SQUEEZE.format(r"regexp_replace(regexp_replace(regexp_replace(translate(lower({}), '‐‑‒–—－', '------'), '[^\p{{L}}\p{{N}}_\s.]', ' ', 'g'), '([^\d]|^)\.', '\1 ', 'g'), '\.([^\d]|$)', ' \1', 'g')")
DIGITS = "array_to_string(list_transform(string_split({}, ' '), lambda x: coalesce(CAST(nullif(list_position([" + ",".join(f"'{w}'" for w in T.NUMBER_WORDS) + "], x), 0) - 1 AS VARCHAR), x)), ' ')"
REFUSED = "(" + ",".join(f"'{r}'" for r in T.REFUSALS) + ")"


def _match(part: str) -> str:
    exact, plain = DIGITS.format(DECIMAL.format(part)), DIGITS.format(NORMAL.format(part))
    return f"""CASE WHEN {exact} = '' THEN false WHEN regexp_matches(replace({exact}, ' ', ''), '^\\p{{Nd}}+$') OR length({exact}) <= 3
        THEN regexp_matches(dec, '(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_.])' || {exact} || '($|[^\\p{{L}}\\p{{N}}\\p{{M}}_.])') ELSE {plain} <> '' AND contains(hay, {plain}) END"""


SCORED = f"""
h AS (SELECT *, {DIGITS.format(NORMAL.format("scrubbed"))} AS hay, {DIGITS.format(DECIMAL.format("scrubbed"))} AS dec, {NORMAL.format("scrubbed")} IN {REFUSED} AS refused
      FROM (SELECT *, {SQUEEZE.format("answer")} AS scrubbed FROM q)),
m AS (SELECT *, hay <> '' AND CASE WHEN refused THEN {NORMAL.format("gold")} IN {REFUSED} ELSE {_match("gold")} END AS m0,
        hay <> '' AND CASE WHEN refused THEN {NORMAL.format("aliases[1]")} IN {REFUSED} ELSE {_match("aliases[1]")} END AS m1,
        hay <> '' AND CASE WHEN refused THEN false ELSE ({_match("string_split(aliases[2], ' & ')[1]")}) AND ({_match("string_split(aliases[2], ' & ')[2]")}) END AS m2 FROM h),
s AS (SELECT conv_id, round_trip, m0 OR m1 OR m2 AS passed, CASE WHEN m0 THEN NULL WHEN m1 THEN aliases[1] WHEN m2 THEN aliases[2] END AS matched_alias FROM m)
"""


def asked(spark, sf_dir):
    """Questions (gold, aliases) and answers, one for each round trip."""
    trips = dialogue.round_trips(table(spark, sf_dir, "conversations"))
    ws = F.filter(F.split("user_text", " "), lambda w: w != "")
    nth = lambda i, other: F.coalesce(F.get(F.col("_w"), i), F.lit(other))
    return trips.withColumn("_w", ws).select("conv_id", "round_trip", nth(1, "").alias("gold"), F.array(nth(2, "x9"), F.concat(nth(0, ""), F.lit(" & "), nth(3, ""))).alias("aliases"), F.when(F.col("round_trip") % 7 == 6, "Not mentioned.").otherwise(F.col("assistant_text")).alias("answer"))


def _answers(spark, sf_dir):
    return scoring.tier1(asked(spark, sf_dir), "gold", "aliases", "answer").select("conv_id", "round_trip", "passed", "matched_alias")


BASE = "WITH" + PAIRED + "," + ASKED + "," + SCORED.replace("s AS (SELECT conv_id, round_trip, m0", "scored AS (SELECT conv_id, round_trip, m0")


@query(BASE + "SELECT * FROM scored")
def answer_scores(spark, sf_dir):
    return _answers(spark, sf_dir)


@query(BASE + "SELECT CASE WHEN grouping(round_trip) = 1 THEN 'all' ELSE CAST(round_trip AS VARCHAR) END AS round_trip, count(*) AS n, CAST(sum(CAST(passed AS INT)) AS BIGINT) AS passed, round(avg(CAST(passed AS INT)), 6) AS accuracy FROM scored GROUP BY GROUPING SETS ((round_trip), ())")
def accuracy_by_round_trip(spark, sf_dir):
    s = _answers(spark, sf_dir).withColumn("p", F.col("passed").cast("int"))
    g = s.groupingSets([["round_trip"], []], "round_trip").agg(F.count("*").alias("n"), F.sum("p").alias("passed"), F.round(F.avg("p"), 6).alias("accuracy"), F.grouping("round_trip").alias("_g"))
    return g.select(F.when(F.col("_g") == 1, "all").otherwise(F.col("round_trip").cast("string")).alias("round_trip"), "n", "passed", "accuracy")


@query(f"""
SELECT conv_id, turn, g <> '' AND contains(t, g) AS found FROM (SELECT conv_id, turn, {NORMAL.format("coalesce(text, '')")} AS t, {NORMAL.format("coalesce(string_split(text, ' ')[3], '')")} AS g FROM conversations)""")
def substring_scores(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", scoring.contained(t, F.coalesce(F.get(F.split("text", " "), 2), F.lit(""))).alias("found"))


@query("""
WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS "both", count(*) FILTER (quality = 1 AND toxic = 0) AS only_a, count(*) FILTER (quality = 0 AND toxic = 1) AS only_b, count(*) FILTER (quality = 0 AND toxic = 0) AS neither FROM labels),
n AS (SELECT *, CAST("both" + only_a + only_b + neither AS DOUBLE) AS n FROM c),
k AS (SELECT *, ("both" + neither) / n AS po, ((CAST("both" AS DOUBLE) + only_a) * ("both" + only_b) + (CAST(neither AS DOUBLE) + only_a) * (neither + only_b)) / (n * n) AS pe FROM n)
SELECT "both", only_a, only_b, neither, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa,
  (SELECT round(sum(exp(lgamma(m + 1.0) - lgamma(i + 1.0) - lgamma(m - i + 1.0) - m * ln(2))), 6) FROM (SELECT unnest(range(k.only_a, k.only_a + k.only_b + 1)) AS i, k.only_a + k.only_b AS m)) AS mcnemar_p FROM k""")
def rater_agreement(spark, sf_dir):
    return scoring.paired(table(spark, sf_dir, "labels"), "quality", "toxic")


@query()
def paired_bootstrap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return scoring.bootstrap(table(spark, sf_dir, "labels").join(docs, "doc_id"), "lang", "quality", "toxic")


@query("""
SELECT lang, count(n_chars) AS n, CAST(min(n_chars) AS DOUBLE) AS low, CAST(max(n_chars) AS DOUBLE) AS high, round(avg(n_chars), 2) AS mean, round(quantile_cont(n_chars, 0.5), 2) AS median,
  round(quantile_cont(n_chars, 0.25), 2) AS p25, round(quantile_cont(n_chars, 0.75), 2) AS p75, round(coalesce(stddev_samp(n_chars), 0), 2) AS sd FROM documents GROUP BY lang""")
def length_spread(spark, sf_dir):
    return scoring.spread(table(spark, sf_dir, "documents"), ["lang"], "n_chars")


@query("""
SELECT n, round(r, 6) AS pearson, round((m1 - m0) / sd * sqrt(n1 * n0 / (n * n)), 6) AS point_biserial FROM (
  SELECT count(*) AS n, corr(quality, n_chars) AS r, avg(n_chars) FILTER (quality = 1) AS m1, avg(n_chars) FILTER (quality = 0) AS m0, CAST(count(*) FILTER (quality = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (quality = 0) AS DOUBLE) AS n0, stddev_samp(n_chars) AS sd
  FROM labels JOIN documents USING (doc_id))""")
def quality_length_correlation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return scoring.correlations(table(spark, sf_dir, "labels").join(docs, "doc_id"), "quality", "n_chars")


@query("""
SELECT event_type, v[least(CAST(floor(len(v) * 0.5) AS INT) + 1, len(v))] AS p50, v[least(CAST(floor(len(v) * CAST(0.95 AS DOUBLE)) AS INT) + 1, len(v))] AS p95 FROM (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type)""")
def latency_percentiles(spark, sf_dir):
    return scoring.index_percentiles(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query("""
WITH q AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 20 = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS candidate_id, least(1.0, greatest(0.0, list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))))) AS score
      FROM q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id)
SELECT query_id, candidate_id, round(score, 6) AS score, score >= 0.92 AS matched FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS r FROM p) WHERE r = 1""")
def nearest_in_group(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select("label", F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    c = e.select("label", F.col("vec_id").alias("candidate_id"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))
    best = matching.best_match(q, c, "label", own=False)
    return best.where("candidate_id IS NOT NULL").select("query_id", "candidate_id", F.round("score", 6).alias("score"), "matched")


@query("""
WITH q AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 20 = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS candidate_id, list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) AS s FROM q LEFT JOIN embeddings c ON q.label = c.label AND c.vec_id % 20 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, candidate_id) AS r FROM p),
b AS (SELECT query_id, arg_min(candidate_id, r) FILTER ((query_id + candidate_id) % 7 = 0) AS y, arg_min(candidate_id, r) AS n FROM r WHERE r <= 5 GROUP BY query_id)
SELECT query_id, coalesce(y, n) AS candidate_id, CAST(CASE WHEN y IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS score FROM b""")
def judged_neighbours(spark, sf_dir):
    """Every 20th vector against all others of its label; the judge is a rule on the two ids."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("vec_id").cast("string").alias("text"), F.col("embedding").alias("vector"))
    q = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    c = e.where("vec_id % 20 <> 0").withColumnRenamed("vec_id", "candidate_id").withColumn("ord", F.col("candidate_id"))
    return matching.judged_match(q, c, "label", lambda a, b: (a.cast("bigint") + b.cast("bigint")) % 7 == 0)


@query("""
WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT label, i, sum(CAST(x AS DOUBLE)) AS s, count(*) AS n, sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) AS q FROM e GROUP BY label, i),
t AS (SELECT label, sum(s * s) AS ss, max(n) AS n, sum(q) AS q FROM s GROUP BY label)
SELECT label, n, round(CASE WHEN n < 2 THEN 1.0 ELSE greatest(0.0, 1 - 2 * abs((ss - q) / (n * (n - 1)) - 0.5)) END, 4) AS contradiction FROM t""")
def vector_contradiction(spark, sf_dir):
    return matching.spread_score(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", "n", F.round("contradiction", 4).alias("contradiction"))


@query("""
WITH r AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS r FROM embeddings), f AS (SELECT * FROM r WHERE r <= 300)
SELECT a.label, count(*) AS pairs, count(*) FILTER (list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) >= 0.92) AS duplicates FROM f a JOIN f b ON a.label = b.label AND a.r < b.r GROUP BY a.label""")
def vector_duplicates(spark, sf_dir):
    return matching.duplicate_share(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


@query("""
SELECT doc_id, CAST(196608 AS BIGINT) * t * t AS prefill_flops, CAST(196608 AS BIGINT) * (9 * t + 45) AS decode_flops, CAST(greatest(1, ceil(t / 512.0)) AS BIGINT) AS forwards,
  CAST(CASE WHEN t % 512 = 1 THEN 513 ELSE 512 END AS BIGINT) AS chunk, CAST(2 * 16 * 4 * 256 * 2 AS BIGINT) * t AS kv_bytes, round(t * 0.042 / 1e6, 12) AS usd FROM (SELECT doc_id, n_chars AS t FROM documents)""")
def reader_costs(spark, sf_dir):
    t = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", N.attention_flops_prefill(t).alias("prefill_flops"), N.attention_flops_decode(t, F.lit(10)).alias("decode_flops"), N.prefill_forwards(t, 512).alias("forwards"), N.effective_prefill_chunk(t, 512).alias("chunk"), N.kv_cache_bytes(t, 16, 4, 256).alias("kv_bytes"), F.round(N.cost_usd(t, 0.042), 12).alias("usd"))


@query("""
SELECT vec_id, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS ties_up, CASE WHEN a <= 0 AND b <= 0 AND c <= 0 THEN 2 WHEN c >= b AND c >= a THEN 2 WHEN b >= a THEN 1 ELSE 0 END AS ties_down,
  CASE WHEN c > 0 THEN 2 WHEN b > 0 THEN 1 WHEN a > 0 THEN 0 ELSE 2 END AS axes, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS likeliest
FROM (SELECT vec_id, CAST(round(embedding[1] * 5) AS INT) AS a, CAST(round(embedding[2] * 5) AS INT) AS b, CAST(round(embedding[3] * 5) AS INT) AS c FROM embeddings)""")
def level_rules(spark, sf_dir):
    from ..operators import tree

    s = table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(F.get("embedding", i) * 5).cast("int").alias(n) for i, n in enumerate("abc")])
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    levels = F.create_map(*[x for i, n in enumerate((a, b, c)) for x in (F.lit(i), n.cast("double"))])
    return s.select("vec_id", tree.level_ties_up(a, b, c).alias("ties_up"), tree.level_ties_down(a, b, c).alias("ties_down"), tree.level_of_axes(a > 0, b > 0, c > 0).alias("axes"), scoring.argmax_level(levels).alias("likeliest"))
