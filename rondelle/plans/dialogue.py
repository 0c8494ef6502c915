"""Queries over conversations and texts: pairing, rendering, windows, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, dialogue, extraction
from .registry import query, table

#: SQL that the counterparts below share.
PAIRED = """
s AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, role IN ('user', 'assistant') AS speaks FROM conversations),
n AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt, lead(turn) OVER w AS nu, lag(role) OVER w AS pr FROM s WINDOW w AS (PARTITION BY conv_id, speaks ORDER BY turn)),
p AS (SELECT conv_id, turn,
        CASE WHEN role = 'user' AND nr = 'assistant' THEN nu * 2 WHEN role = 'user' THEN coalesce(nu * 2 - 1, 4611686018427387904) ELSE turn * 2 END AS pos,
        CASE WHEN role = 'assistant' THEN '' ELSE text END AS user_text,
        CASE WHEN role = 'user' AND nr = 'assistant' THEN nt WHEN role = 'assistant' THEN text ELSE '' END AS assistant_text
      FROM n WHERE NOT (role = 'assistant' AND coalesce(pr, '') = 'user')),
trips AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos, turn) - 1 AS round_trip, user_text, assistant_text FROM p)
"""

STRIP = r"regexp_replace({}, '^[\s\x0b\x85\xa0]+|[\s\x0b\x85\xa0]+$', '', 'g')"
SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
NORMAL = SQUEEZE.format(r"regexp_replace(translate(lower({}), '‐‑‒–—－', '------'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')")


@query("WITH" + PAIRED + "SELECT conv_id, round_trip, user_text, assistant_text FROM trips")
def round_trips(spark, sf_dir):
    return dialogue.round_trips(table(spark, sf_dir, "conversations"))


@query("WITH" + PAIRED.replace("FROM conversations", "FROM (SELECT conv_id, turn, role, trim(text) AS text FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> '')") + """
SELECT conv_id, round_trip, CASE WHEN user_text <> '' THEN 'User: ' || user_text ELSE '' END AS user_text,
       CASE WHEN assistant_text <> '' THEN 'Assistant: ' || assistant_text ELSE '' END AS assistant_text FROM trips""")  # fmt: skip
def labelled_pairs(spark, sf_dir):
    return dialogue.labelled_pairs(table(spark, sf_dir, "conversations"))


@query("WITH" + PAIRED + "SELECT conv_id, round_trip, '### Human' || chr(10) || user_text || chr(10) || CASE WHEN assistant_text <> '' THEN '### text' || chr(10) || assistant_text ELSE '' END AS block FROM trips")
def round_trip_blocks(spark, sf_dir):
    trips = dialogue.round_trips(table(spark, sf_dir, "conversations"))
    return trips.select("conv_id", "round_trip", dialogue.render_round_trip(F.col("user_text"), F.col("assistant_text")).alias("block"))


@query("SELECT conv_id, string_agg(upper(role) || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS session FROM conversations GROUP BY conv_id")
def session_text(spark, sf_dir):
    return dialogue.render_session(table(spark, sf_dir, "conversations"))


@query("""
SELECT conv_id, turn, coalesce(length(t) <= 300 AND regexp_matches(t, '[?？]$'), false) AS asks,
       coalesce(length(t) BETWEEN 1 AND 300 AND (ends_with(t, '?') OR contains(lower(t), 'one word')
         OR regexp_matches(lower(t), '^(what|when|where|who|which|how|why|did|do|does|is|are|can|could|would|will|tell me|remind me|recall)($|[^\\p{L}''])')), false) AS asks_en
FROM (SELECT conv_id, turn, """.replace("\\\\", "\\") + STRIP.format("text") + " AS t FROM conversations)")
def query_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    no = F.lit(False)
    return c.select("conv_id", "turn", F.coalesce(T.is_query_turn(F.col("text")), no).alias("asks"), F.coalesce(T.is_query_turn_en(F.col("text")), no).alias("asks_en"))


@query("""
SELECT conv_id, turn, sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) <= 1200 AS kept,
       sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) <= 150 OR row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS kept_one
FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)""")
def recency_window(spark, sf_dir):
    units = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length(F.coalesce("text", F.lit(""))) + 2).alias("cost"))
    first = dialogue.newest_within(units, "conv_id", "turn", "cost", 1200).withColumnRenamed("kept", "first")
    both = dialogue.newest_within(first, "conv_id", "turn", "cost", 150, keep_one=True)
    return both.select("conv_id", "turn", F.col("first").alias("kept"), F.col("kept").alias("kept_one"))


@query("""
SELECT conv_id, turn, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2 THEN coalesce(text, '') ELSE left(coalesce(text, ''), 40) END AS shown,
       CASE WHEN length(coalesce(text, '')) > 60 THEN '...' || chr(10) || right(coalesce(text, ''), 60) ELSE coalesce(text, '') END AS tail FROM conversations""")
def summary_window(spark, sf_dir):
    units = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).withColumn("summary", F.left("text", F.lit(40)))
    shown = dialogue.summaries_then_last(units, "conv_id", "turn", "text", "summary", 2)
    return shown.select("conv_id", "turn", "shown", dialogue.tail_text(F.col("text"), 60).alias("tail"))


@query("""
SELECT * FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS "count",
  sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)::BIGINT AS recent FROM conversations) WHERE "count" % 5 = 0""")
def every_fifth_turn(spark, sf_dir):
    units = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size"))
    return dialogue.every_nth_with_recent(units, "conv_id", "turn", "size", 5).select("conv_id", "turn", "count", "recent")


@query("""
SELECT conv_id, turn, sum(1) OVER w <= 5 AND coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 200 AS admitted
FROM (SELECT conv_id, turn, greatest(1, length(coalesce(text, '')) // 4) AS tokens FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def request_admission(spark, sf_dir):
    units = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit(1).alias("requests"), T.estimate_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return dialogue.admitted(units, "conv_id", "turn", "requests", "tokens", 5, 200).select("conv_id", "turn", "admitted")


#: A left fold over a list of chunks: a short one joins the one before it, which only depends on its own length.
CHUNKS = r"""
u AS (SELECT conv_id, round_trip, source, t FROM (SELECT conv_id, round_trip, 'user' AS source, user_text AS t FROM trips UNION ALL SELECT conv_id, round_trip, 'assistant', assistant_text FROM trips)),
c AS (SELECT conv_id, round_trip, source, list_filter(list_transform(string_split(regexp_replace(t, '(.)((?:また|例えば|ところで|しかし|ただし|なお|一方|さらに|そして|次に|つまり|従って|したがって|そのため)[、,])', '\1' || chr(1) || '\2', 'gs'), chr(1)), lambda x: STRIP(x)), lambda x: x <> '') AS first FROM (SELECT conv_id, round_trip, source, STRIP(t) AS t FROM u)),
w AS (SELECT conv_id, round_trip, source, flatten(list_transform(first, lambda x: CASE WHEN length(x) // 4 <= 200 THEN [x] ELSE list_filter(list_transform(string_split(regexp_replace(x, '([。！？!?])', '\1' || chr(1), 'g'), chr(1)), lambda y: STRIP(y)), lambda y: y <> '') END)) AS whole FROM c),
h AS (SELECT conv_id, round_trip, source, list_filter(flatten(list_transform(whole, lambda x: list_transform(range(0, length(x), 800), lambda i: STRIP(substring(x, i + 1, 800))))), lambda x: x <> '') AS pieces FROM w),
e AS (SELECT conv_id, round_trip, source, unnest(pieces) AS text, generate_subscripts(pieces, 1) AS i FROM h),
g AS (SELECT *, sum(CASE WHEN i = 1 OR length(text) >= 12 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, round_trip, source ORDER BY i) AS grp FROM e)
SELECT conv_id, round_trip, source, CAST(grp - 1 AS BIGINT) AS seq, string_agg(text, '' ORDER BY i) AS text FROM g GROUP BY conv_id, round_trip, source, grp
"""


def _strips(sql: str) -> str:
    import re

    return re.sub(r"STRIP\(((?:[^()]|\([^()]*\))*)\)", lambda m: STRIP.format(m[1]), sql)


@query("WITH" + PAIRED + "," + _strips(CHUNKS))
def round_trip_chunks(spark, sf_dir):
    return chunking.chunk_round_trips(dialogue.round_trips(table(spark, sf_dir, "conversations")))


UNITS = r"""
WITH a AS (SELECT doc_id, STRIP(coalesce(text, '')) AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([。！？]+)', '\1' || chr(1), 'g'), '([.!?])(\s|$)', '\1' || chr(1) || '\2', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '(^|[^A-Za-z.]|(?:^|[^A-Za-z])\.)(ABBR)\.' || chr(1), '\1\2.', 'gi') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(t, '([,;:—–-]\s*)(EN)($|[^\p{L}\p{N}_])', '\1' || chr(1) || '\2\3', 'gi') AS t FROM c)
SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda x: STRIP(x)), lambda x: x <> '') AS units FROM d
"""


@query(_strips(UNITS.replace("ABBR", "|".join(a.replace(".", r"\.") for a in T.ABBREVIATIONS)).replace("EN)", "|".join(T.EN_CONNECTIVES) + ")")))
def sentence_units(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.split_units(F.coalesce("text", F.lit(""))).alias("units"))


@query()
def chunk_candidates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.candidates(docs, "text", 400).select("doc_id", F.posexplode("chunks").alias("seq", "chunk"))


@query("""
SELECT conv_id, turn, CAST(len(w) AS BIGINT) AS n, w[1] AS first, w[-1] AS last FROM (SELECT conv_id, turn,
  list_transform(range(0, greatest(1, length(t) - 29), 5), lambda i: substring(t, i + 1, 30)) AS w FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations))""")
def sliding_windows(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", chunking.windows(F.coalesce("text", F.lit(""))).alias("w"))
    return c.select("conv_id", "turn", F.size("w").cast("bigint").alias("n"), F.get("w", 0).alias("first"), F.element_at("w", -1).alias("last"))


@query(f"""
SELECT doc_id, {NORMAL.format("t")} AS normal, md5(regexp_replace(replace(lower(t), 'ß', 'ss'), '[\\p{{P}}\\p{{Z}}\\p{{C}}]', '', 'g')) AS dedup_key,
  array_to_string(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')[1:32], ' ') AS words32, greatest(1, length(t) // 4)::INT AS tokens FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def normalised_texts(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", T.normalise(t).alias("normal"), F.md5(T.dedup_key(t).cast("binary")).alias("dedup_key"), T.truncate_words(t, 32).alias("words32"), T.estimate_tokens(t).alias("tokens"))


@query("""
SELECT key, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, md5(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\\p{P}\\p{Z}\\p{C}]', '', 'g')) AS key FROM documents) GROUP BY key""".replace("\\\\", "\\"))
def statement_dedup(spark, sf_dir):
    key = F.md5(T.dedup_key(F.coalesce("text", F.lit(""))).cast("binary")).alias("key")
    return table(spark, sf_dir, "documents").select("doc_id", key).groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


#: Replies of a model as they come, made from the turns.
REPLY = """CASE turn % 6 WHEN 0 THEN 'Answer: yes, ' || text WHEN 1 THEN '<think>' || text || '</think>' || chr(10) || ' No' WHEN 2 THEN '- B) ' || conv_id || '7.5 ' || text
 WHEN 3 THEN '<<< ' || text || ' >>> C' WHEN 4 THEN '<think>' || text ELSE 'score ' || (turn * 31) || ' is not ' || text END"""


@query(f"""
WITH r AS (SELECT conv_id, turn, {REPLY} AS reply FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)),
t AS (SELECT *, trim(regexp_replace(regexp_replace(reply, '(?is)<think>.*?</think>', '', 'g'), '(?is)<think>.*$', ''), ' ' || chr(10)) AS bare FROM r),
f AS (SELECT *, coalesce(list_filter(list_transform(string_split(bare, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '') AS line FROM t)
SELECT conv_id, turn, bare, line, trim(regexp_extract(reply, '(?s)<<<(.*?)>>>', 1)) AS fenced, nullif(regexp_extract(reply, '(?:^|[^\\p{{L}}])([A-D])(?:$|[^\\p{{L}}])', 1), '') AS letter,
  CASE WHEN regexp_matches(reply, '\\d') THEN least(100, CAST(regexp_extract(reply, '(\\d{{1,9}})', 1) AS INT)) ELSE 50 END AS score,
  CASE WHEN regexp_matches(reply, '\\d') THEN least(1.0, CAST(regexp_extract(reply, '(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE)) ELSE 0.0 END AS score01
FROM f""")
def reply_parsing(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    r = c.withColumn("reply", F.expr(REPLY.replace("chr(10)", "char(10)")))
    reply = F.col("reply")
    return r.select("conv_id", "turn", T.strip_think(reply).alias("bare"), T.first_line(reply).alias("line"), T.fenced_span(reply).alias("fenced"), T.answer_letter(reply).alias("letter"), T.first_int(reply).alias("score"), T.first_number01(reply).alias("score01"))


#: The rules of names and facts again. Word bounds are ASCII there, so other letters are shown as one that is.
STOP = "[" + ", ".join(f"'{w}'" for w in extraction.NOT_NAMES) + "]"
SOUND = "NOT list_contains(" + STOP + ", regexp_split_to_array({0}, '\\s+')[1]) AND NOT list_contains(" + STOP + ", {0}) AND (regexp_matches({0}, '\\s') OR length({0}) >= 3) AND NOT regexp_matches({0}, '^[A-Z]{{1,4}}$')"


@query(rf"""
WITH c AS (SELECT conv_id, turn, text, regexp_extract_all(regexp_replace(text, '[^\x00-\x7F\P{{L}}]', '_', 'g'), '\b([A-Z][a-z]+(?:\s+[A-Z][a-zA-Z]+){{0,2}})\b', 1) AS p FROM conversations WHERE regexp_matches(text, '\S')),
w AS (SELECT *, flatten(list_transform(p, lambda x, i: CASE WHEN {SOUND.format("x")} AND list_position(p, x) = i THEN [x] ELSE list_filter(regexp_split_to_array(x, '\s+'), lambda y: {SOUND.format("y")}) END)) AS ws FROM c),
e AS (SELECT *, list_filter(ws, lambda x, i: list_position(ws, x) = i)[:3] AS es FROM w),
s AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) BETWEEN 20 AND 200 AND (len(list_filter(es, lambda n: contains(x, n))) > 0 OR regexp_matches(x, '(?i)\b((19|20)\d\d\b|yesterday|today|tomorrow|tonight|\d{{1,2}}/\d{{1,2}}|\d{{4}}-\d{{1,2}}-\d{{1,2}})'))) AS ss FROM e),
f AS (SELECT *, list_filter(ss, lambda x, i: list_position(ss, x) = i AND NOT list_contains(es, x))[:4] AS fs FROM s),
r AS (SELECT conv_id, turn, es, unnest(es) AS text, 'entity' AS kind FROM f UNION ALL SELECT conv_id, turn, es, unnest(fs), 'fact' FROM f)
SELECT conv_id, turn, kind, text[:160] AS text, CASE kind WHEN 'entity' THEN 'Conversation' ELSE coalesce(list_filter(es, lambda n: contains(text, n))[1], es[1], '') END AS parent FROM r""")
def dialogue_facts(spark, sf_dir):
    """Names and fact sentences of every message, under one root."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return extraction.fact_sentences(c, "text", 3, 4, root="Conversation").where("kind <> 'root'").select("conv_id", "turn", "kind", "text", "parent")
