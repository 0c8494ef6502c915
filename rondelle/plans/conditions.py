"""Queries over conditions, cells, prompts and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import choices, conditions, context, dialogue, tree
from ..sources import runs
from .dialogue import NORMAL, PAIRED
from .evaluation import ASKED, SCORED, asked
from .registry import query, table
from .trees import TREE, nodes

#: The scored questions with what a judge would say of some, as the table ``items``.
ITEMS = """
items AS (SELECT conv_id, round_trip, answer, gold, CASE WHEN m0 OR m1 OR m2 THEN 'pass' WHEN scrubbed = '' OR refused THEN 'fail' WHEN judged THEN 'pass' WHEN NOT judged THEN 'fail' ELSE 'indeterminate' END AS verdict,
    CASE WHEN m0 OR m1 OR m2 OR scrubbed = '' OR refused OR judged IS NULL THEN 1 ELSE 2 END AS tier, CASE WHEN m0 THEN NULL WHEN m1 THEN aliases[1] WHEN m2 THEN aliases[2] END AS matched_alias
  FROM (SELECT *, CASE round_trip % 5 WHEN 0 THEN true WHEN 1 THEN false END AS judged FROM m))
"""
JUDGED = "WITH" + PAIRED + "," + ASKED + "," + SCORED.replace("s AS (SELECT conv_id, round_trip, m0", "scored AS (SELECT conv_id, round_trip, m0") + "," + ITEMS


def items(spark, sf_dir):
    turn = F.col("round_trip") % 5
    return conditions.verdicts(asked(spark, sf_dir), "gold", "aliases", "answer", F.when(turn == 0, F.lit(True)).when(turn == 1, F.lit(False)))


@query(JUDGED + "SELECT conv_id, round_trip, verdict, tier, matched_alias FROM items")
def condition_scores(spark, sf_dir):
    return items(spark, sf_dir).select("conv_id", "round_trip", "verdict", "tier", "matched_alias")


@query(JUDGED + """SELECT conv_id, count(*) FILTER (verdict = 'pass') AS n_pass, count(*) FILTER (verdict = 'fail') AS n_fail, count(*) FILTER (verdict = 'indeterminate') AS n_indeterminate, count(*) AS total,
round(count(*) FILTER (verdict = 'pass') / count(*), 4) AS pass_rate FROM items GROUP BY conv_id""")
def condition_summary(spark, sf_dir):
    return conditions.summary(items(spark, sf_dir), "conv_id")


@query("WITH" + PAIRED + "," + ASKED + f""", f AS (SELECT conv_id, {NORMAL.format("gold")} AS g, {NORMAL.format("answer")} AS a FROM q), d AS (SELECT DISTINCT conv_id, g FROM f WHERE g <> '')
SELECT conv_id, count(*) FILTER (k >= 2) AS n FROM (SELECT conv_id, (SELECT count(*) FROM d WHERE d.conv_id = f.conv_id AND contains(f.a, d.g)) AS k FROM f) GROUP BY conv_id""")
def multi_gold_answers(spark, sf_dir):
    return conditions.multi_gold_answers(asked(spark, sf_dir), "conv_id", "gold", "answer")


ARMS = "WITH" + PAIRED + "," + ASKED.replace("q AS (", "q0 AS (") + """, q AS (SELECT conv_id, round_trip, gold, aliases, arm, CASE WHEN arm = 'P' AND (conv_id + round_trip) % 3 = 0 THEN 'Not mentioned.' WHEN arm = 'A' AND round_trip % 4 = 1 THEN '' ELSE answer END AS answer FROM q0, (SELECT unnest(['A', 'P']) AS arm)),
""" + SCORED.replace("s AS (SELECT conv_id, round_trip, m0", "scored AS (SELECT conv_id, round_trip, arm, m0")  # fmt: skip


@query(ARMS + """, b AS (SELECT conv_id, round_trip, bool_or(passed) FILTER (arm = 'P') AS p, bool_or(passed) FILTER (arm = 'A') AS o FROM scored GROUP BY ALL)
SELECT conv_id % 5 AS cell, count(*) AS n_questions, count(*) FILTER (p AND o) AS both_pass, count(*) FILTER (NOT p AND NOT o) AS both_fail, count(*) FILTER (o AND NOT p) AS other_only, count(*) FILTER (p AND NOT o) AS proposed_only FROM b GROUP BY ALL""")
def cell_scores(spark, sf_dir):
    q = asked(spark, sf_dir).withColumn("arm", F.explode(F.array(F.lit("A"), F.lit("P"))))
    lost = (F.col("arm") == "P") & ((F.col("conv_id") + F.col("round_trip")) % 3 == 0)
    q = q.withColumn("answer", F.when(lost, "Not mentioned.").when((F.col("arm") == "A") & (F.col("round_trip") % 4 == 1), "").otherwise(F.col("answer")))
    scored = conditions.verdicts(q, "gold", "aliases", "answer").select((F.col("conv_id") % 5).alias("cell"), F.concat_ws("/", "conv_id", "round_trip").alias("question"), "arm", "verdict")
    return conditions.paired_cells(scored, "cell", "question", "arm", "P", "A")


@query("""SELECT event_type, round(avg(CASE WHEN event_id % 7 > 0 THEN value END), 6) AS value_mean, count(*) FILTER (event_id % 7 = 0 OR value IS NULL) AS value_missing, round(avg(CASE WHEN user_id < 0 THEN value END), 6) AS none_mean, count(*) AS none_missing FROM events GROUP BY event_type""")
def compute_means(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 7 > 0, F.col("value")).alias("value"), F.when(F.col("user_id") < 0, F.col("value")).alias("none"))
    means = conditions.compute_summary(e, ["value", "none"], "event_type")
    return means.withColumns({c: F.round(c, 6) for c in ("value_mean", "none_mean")})


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 > 0 THEN -1 WHEN contains(CASE WHEN conv_id % 2 = 0 THEN t ELSE upper(t) END, coalesce(string_split(t, ' ')[3], 'x')) THEN 1 ELSE 0 END AS hit FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)""")
def recall_hits(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("t", F.coalesce("text", F.lit("")))
    fact = F.coalesce(F.get(F.split("t", " "), 2), F.lit("x"))
    said = F.when(F.col("conv_id") % 2 == 0, F.col("t")).otherwise(F.upper("t"))
    return c.select("conv_id", "turn", conditions.recall_hit(F.when(F.col("turn") % 3 == 0, "recall"), fact, said).alias("hit"))


@query("WITH" + PAIRED + """, w AS (SELECT conv_id, round_trip, list_filter(string_split(user_text, ' '), lambda x: x <> '') AS ws, list_filter(string_split(assistant_text, ' '), lambda x: x <> '') AS vs FROM trips),
f AS (SELECT DISTINCT conv_id, ws[1] AS name, vs[2] AS code FROM w WHERE round_trip % 2 = 0 AND len(ws) > 0 AND len(vs) > 1)
SELECT conv_id, name, code, EXISTS (SELECT 1 FROM trips t WHERE t.conv_id = f.conv_id AND t.round_trip % 2 = 1 AND contains(translate(t.user_text, '‐‑–—－', '-----'), translate(name, '‐‑–—－', '-----')) AND contains(translate(t.assistant_text, '‐‑–—－', '-----'), translate(code, '‐‑–—－', '-----'))) AS hit FROM f""")
def fact_hits(spark, sf_dir):
    trips = dialogue.round_trips(table(spark, sf_dir, "conversations"))
    ws = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    facts = trips.where("round_trip % 2 = 0").select("conv_id", F.get(ws("user_text"), 0).alias("name"), F.get(ws("assistant_text"), 1).alias("code")).where("name IS NOT NULL AND code IS NOT NULL")
    records = trips.where("round_trip % 2 = 1").select("conv_id", "user_text", F.col("assistant_text").alias("response"))
    return conditions.fact_hits(records, facts, "conv_id")


def quarter(n):
    """Tokens of so many characters, by the rule of four characters a token."""
    return F.floor(n / 4).cast("bigint")


@query("WITH" + PAIRED + """, u AS (SELECT conv_id, round_trip, '### Human' || chr(10) || user_text || chr(10) || CASE WHEN assistant_text <> '' THEN '### text' || chr(10) || assistant_text ELSE '' END AS unit, 'Topics of ' || conv_id AS block FROM trips),
r AS (SELECT *, (120 + length(block) + sum(length(unit) + 2) OVER (PARTITION BY conv_id ORDER BY round_trip DESC)) // 4 <= 400 AS kept FROM u),
c AS (SELECT conv_id, count(*) FILTER (kept) AS n_recent, min(round_trip) FILTER (kept) AS first_recent, '<context>' || chr(10) || any_value(block) || coalesce(chr(10) || chr(10) || string_agg(unit, chr(10) || chr(10) ORDER BY round_trip) FILTER (kept), '') || chr(10) || '</context>' AS context FROM r GROUP BY conv_id)
SELECT conv_id, CAST((120 + length(context) - 21) // 4 AS BIGINT) AS window_tokens, n_recent, first_recent, context FROM c""")
def prompt_window(spark, sf_dir):
    trips = dialogue.round_trips(table(spark, sf_dir, "conversations"))
    units = trips.withColumn("unit", dialogue.render_round_trip(F.col("user_text"), F.col("assistant_text")))
    return context.prompt_window(units, "conv_id", "round_trip", "unit", F.lit(120), F.concat(F.lit("Topics of "), F.col("conv_id").cast("string")), 400, quarter)


PROMPTS = "q AS (SELECT conv_id, turn, coalesce(text, '') AS question, (length('<context>' || chr(10) || 'c' || conv_id || chr(10) || '</context>' || chr(10) || chr(10) || 'Question: ' || coalesce(text, '') || chr(10) || 'Answer:')) // 4 AS prompt_tokens FROM conversations WHERE role = 'user')"


def _prompts(spark, sf_dir):
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("question"))
    return q, context.assemble(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.array().cast("array<string>"))


@query("WITH " + PROMPTS + " SELECT conv_id, turn, CAST(prompt_tokens AS BIGINT) AS prompt_tokens, prompt_tokens <= 60 AS fits FROM q")
def question_fit(spark, sf_dir):
    q, block = _prompts(spark, sf_dir)
    return context.question_fit(q, "question", block, 60, quarter).select("conv_id", "turn", "prompt_tokens", "fits")


@query("WITH " + PROMPTS + " SELECT conv_id, question, CAST(prompt_tokens AS BIGINT) AS prompt_tokens FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY prompt_tokens DESC, question) AS r FROM q) WHERE r = 1")
def budget_question(spark, sf_dir):
    q, block = _prompts(spark, sf_dir)
    return context.longest_question(q, "conv_id", "question", block, quarter)


@query(TREE + "SELECT conv_id, count(*) FILTER (level = 1) AS planets FROM nodes GROUP BY conv_id")
def planet_lines(spark, sf_dir):
    return tree.render(nodes(spark, sf_dir), level_markers=True).select("conv_id", context.planet_lines(F.col("block")).cast("bigint").alias("planets"))


@query("""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') AS ws FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN repeat(coalesce(text, '') [1:3] || ' ', 7) ELSE coalesce(text, '') END AS t FROM conversations))
SELECT conv_id, turn, len(ws) = 0 OR (len(ws) >= 6 AND len(list_distinct(ws)) <= 2) AS degenerate FROM w""")
def degenerate_turns(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    c = table(spark, sf_dir, "conversations").withColumn("t", F.when(F.col("turn") % 3 == 0, F.repeat(F.concat(F.left(text, F.lit(3)), F.lit(" ")), F.lit(7))).otherwise(text))
    return c.select("conv_id", "turn", runs.degenerate(F.col("t")).alias("degenerate"))


@query("""SELECT n, CASE WHEN n <= 20 THEN [CAST(n AS VARCHAR), w] ELSE [CAST(n AS VARCHAR)] END AS of_digits, CASE WHEN n <= 20 THEN [w, CAST(n AS VARCHAR)] END AS of_word FROM (SELECT r_regionkey * 6 AS n, [""" + ",".join(f"'{w}'" for w in T.NUMBER_WORDS) + """][r_regionkey * 6 + 1] AS w FROM region)""")
def number_spellings(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in T.NUMBER_WORDS])
    r = table(spark, sf_dir, "region").select((F.col("r_regionkey") * 6).alias("n")).withColumn("w", F.get(words, F.col("n").cast("int")))
    return r.select("n", T.number_spellings(F.col("n").cast("string")).alias("of_digits"), F.when(F.col("w").isNotNull(), T.number_spellings(F.col("w"))).alias("of_word"))


@query("""SELECT conv_id, turn, CAST(16 * (greatest(n - 1, 0) + CASE WHEN turn % 2 = 1 THEN turn + 1 ELSE 0 END) AS BIGINT) AS applied, CAST(CASE WHEN turn % 2 = 1 THEN 0 ELSE 16 * (turn + 1) END AS BIGINT) AS skipped_prefill, CAST(0 AS BIGINT) AS skipped_sliding, CAST(CASE WHEN turn % 3 = 0 THEN 16 ELSE 0 END AS BIGINT) AS applied_last_row FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS n FROM conversations)""")
def bias_counters(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    n = runs.bias_counters(F.lit(16), F.length(F.coalesce("text", F.lit(""))), F.col("turn") + 1, (F.col("turn") % 2) * 0.5, F.col("turn") % 3 == 0)
    return c.select("conv_id", "turn", n.alias("n")).select("conv_id", "turn", *[F.col(f"n.{k}").cast("bigint").alias(k) for k in ("applied", "skipped_prefill", "skipped_sliding", "applied_last_row")])


@query("WITH" + PAIRED + """SELECT conv_id, sha256(string_agg(sha256(CAST(to_json({'assistant_text': assistant_text, 'round_trip': round_trip, 'user_text': user_text}) AS VARCHAR)), ',' ORDER BY round_trip)) AS sha256 FROM trips GROUP BY conv_id""")
def corpus_digests(spark, sf_dir):
    return runs.corpus_digest(dialogue.round_trips(table(spark, sf_dir, "conversations")), "conv_id", "round_trip", ["user_text", "assistant_text", "round_trip"])


@query()
def multiple_choice(spark, sf_dir):
    """Four options of each round trip in the order of its id, and the right one's letter."""
    trips = dialogue.round_trips(table(spark, sf_dir, "conversations"))
    ws = F.filter(F.split("assistant_text", " "), lambda w: w != "")
    q = trips.select(F.concat_ws("/", "conv_id", "round_trip").alias("qid"), F.col("user_text").alias("answer"), F.slice(ws, 1, 3).alias("wrong"))
    q = q.withColumn("options", choices.shuffled_options(F.col("qid"), F.col("answer"), F.col("wrong")))
    return q.select("qid", choices.option_lines(F.col("options")).alias("lines"), choices.correct_letter(F.col("options"), F.col("answer")).alias("letter"))
