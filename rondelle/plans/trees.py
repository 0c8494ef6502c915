"""Queries over topic trees built from conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markers, spans
from ..functions import text as T
from ..operators import dialogue, matching, merging, tree
from .dialogue import PAIRED
from .registry import query, table


def facts(spark, sf_dir):
    """What each round trip says: topic (first word of the user's side), sub-topic (first word of a sentence of the answer), detail (that sentence)."""
    trips = dialogue.round_trips(table(spark, sf_dir, "conversations"))
    word = lambda c: F.lower(F.regexp_extract(c, r"(\p{L}+)", 1))
    each = trips.select("conv_id", F.col("round_trip").alias("created"), word(F.col("user_text")).alias("topic"), F.posexplode_outer(F.filter(F.transform(F.split("assistant_text", r"\."), T.strip), lambda s: s.rlike(r"\p{L}"))).alias("seq", "detail"))
    each = each.withColumn("topic", F.when(F.col("topic") == "", F.lit("(none)")).otherwise(F.col("topic")))
    return each.where("topic IS NOT NULL").select("conv_id", "created", F.coalesce(F.col("seq"), F.lit(-1)).cast("bigint").alias("seq"), "topic", word(F.col("detail")).alias("sub_topic"), "detail")


def nodes(spark, sf_dir, floor: float = 1.0):
    merged = tree.within_capacity(tree.merge_exact(facts(spark, sf_dir)))
    return tree.with_coordinates(tree.with_mass(merged, floor))


FACTS = r"""
ft AS (SELECT conv_id, user_text, round_trip AS created, coalesce(nullif(lower(regexp_extract(user_text, '(\p{L}+)', 1)), ''), '(none)') AS topic, list_filter(list_transform(string_split(assistant_text, '.'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: regexp_matches(x, '\p{L}')) AS ds FROM trips),
fe AS (SELECT conv_id, created, topic, ds, unnest(CASE WHEN len(ds) = 0 THEN [-1] ELSE range(0, len(ds)) END) AS seq FROM ft WHERE user_text IS NOT NULL),
facts AS (SELECT conv_id, created, seq, topic, CASE WHEN seq >= 0 THEN ds[seq + 1] END AS detail, CASE WHEN seq >= 0 THEN lower(regexp_extract(ds[seq + 1], '(\p{L}+)', 1)) END AS sub_topic FROM fe),
t0 AS (SELECT conv_id, topic, min((created, seq)) AS f FROM facts GROUP BY ALL),
t1 AS (SELECT conv_id, topic, sub_topic, min((created, seq)) AS f FROM facts WHERE sub_topic IS NOT NULL GROUP BY ALL),
t2 AS (SELECT conv_id, topic, sub_topic, detail, min((created, seq)) AS f FROM facts WHERE detail IS NOT NULL GROUP BY ALL),
i0 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY f) - 1 AS topic_idx FROM t0),
m1 AS (SELECT t1.*, greatest(1.0, (SELECT count(*) FROM t2 WHERE t2.conv_id = t1.conv_id AND t2.topic = t1.topic AND t2.sub_topic = t1.sub_topic)) AS mass FROM t1),
i1 AS (SELECT m1.*, i0.topic_idx, row_number() OVER (PARTITION BY m1.conv_id, m1.topic ORDER BY m1.f) - 1 AS sub_idx FROM m1 JOIN i0 ON m1.conv_id = i0.conv_id AND m1.topic = i0.topic),
i2 AS (SELECT t2.*, i1.topic_idx, i1.sub_idx, row_number() OVER (PARTITION BY t2.conv_id, t2.topic, t2.sub_topic ORDER BY t2.f) - 1 AS detail_idx FROM t2 JOIN i1 ON t2.conv_id = i1.conv_id AND t2.topic = i1.topic AND t2.sub_topic = i1.sub_topic),
nodes AS (SELECT i0.conv_id, 0 AS level, i0.topic AS text, CAST(coalesce(x.m, 1.0) AS DOUBLE) AS mass, CAST(i0.f[1] AS BIGINT) AS created, CAST(topic_idx AS INT) AS topic_idx, -1 AS sub_idx, -1 AS detail_idx FROM i0 LEFT JOIN (SELECT conv_id, topic, sum(mass) AS m FROM m1 GROUP BY ALL) x ON i0.conv_id = x.conv_id AND i0.topic = x.topic
  UNION ALL SELECT conv_id, 1, sub_topic, CAST(mass AS DOUBLE), CAST(f[1] AS BIGINT), CAST(topic_idx AS INT), CAST(sub_idx AS INT), -1 FROM i1
  UNION ALL SELECT conv_id, 2, detail, CAST(0.1 AS DOUBLE), CAST(f[1] AS BIGINT), CAST(topic_idx AS INT), CAST(sub_idx AS INT), CAST(detail_idx AS INT) FROM i2)
"""
TREE = "WITH" + PAIRED + "," + FACTS
LINE = "repeat('  ', level) || {} || ' ' || text"
PN = "'[PN' || CAST(CAST(mass AS DECIMAL(18,1)) AS VARCHAR) || ']'"
ORDER = "ORDER BY topic_idx, sub_idx, detail_idx"
BLOCK = "'<CONTEXT>' || chr(10) || string_agg({}, chr(10) " + ORDER + ") || chr(10) || '</CONTEXT>'"


@query(TREE + "SELECT conv_id, level, text, mass, created, topic_idx, sub_idx, detail_idx FROM nodes")
def conversation_tree(spark, sf_dir):
    return nodes(spark, sf_dir).select("conv_id", "level", "text", "mass", "created", "topic_idx", "sub_idx", "detail_idx")


@query(TREE + f"SELECT conv_id, {BLOCK.format(LINE.format(PN))} AS block FROM nodes GROUP BY conv_id")
def tree_context_block(spark, sf_dir):
    return tree.render(nodes(spark, sf_dir))


@query(TREE + f"SELECT conv_id, {BLOCK.format(LINE.format(f"CASE level WHEN 0 THEN '[SN]' WHEN 1 THEN {PN} ELSE '[RN]' END"))} AS block FROM nodes GROUP BY conv_id")
def tree_level_block(spark, sf_dir):
    return tree.render(nodes(spark, sf_dir), level_markers=True)


@query(TREE + """, ms AS (SELECT *, mass / sum(mass) OVER (PARTITION BY conv_id) AS p FROM nodes), b AS (SELECT conv_id, count(*) FILTER (level = 0) AS topics, count(*) FILTER (level = 1) AS sub_topics, count(*) FILTER (level = 2) AS details, count(*) AS n, -sum(p * ln(p + 1e-12)) AS h FROM ms GROUP BY conv_id),
o AS (SELECT conv_id, count(*) AS o FROM i0 WHERE NOT EXISTS (SELECT 1 FROM t1 WHERE t1.conv_id = i0.conv_id AND t1.topic = i0.topic) GROUP BY conv_id)
SELECT b.conv_id, topics, sub_topics, details, round(details / CAST(n AS DOUBLE), 6) AS depth_ratio, round(coalesce(o, 0) / CAST(topics AS DOUBLE), 6) AS bare_topics, round(CASE WHEN n > 1 THEN h / ln(n) ELSE 0 END, 6) AS entropy FROM b LEFT JOIN o ON b.conv_id = o.conv_id""")  # fmt: skip
def tree_metrics(spark, sf_dir):
    return tree.metrics(nodes(spark, sf_dir))


@query(TREE + "SELECT level, count(*) AS n, round(sum(mass), 6) AS mass, count(DISTINCT conv_id) AS trees FROM nodes GROUP BY level")
def tree_summary(spark, sf_dir):
    return nodes(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n"), F.round(F.sum("mass"), 6).alias("mass"), F.countDistinct("conv_id").alias("trees"))


@query(TREE + "SELECT conv_id, topic_idx, sub_idx, detail_idx, text, created FROM nodes")
def tree_by_fold(spark, sf_dir):
    """The merge as a fold in order, as any similarity needs it; with equal texts it must give the same tree."""
    return merging.merge_conversations(facts(spark, sf_dir))


@query(TREE + """,
jd AS (SELECT conv_id, topic_idx, sub_idx, string_agg(CAST(to_json(text) AS VARCHAR), ',' ORDER BY detail_idx) AS ds FROM nodes WHERE level = 2 GROUP BY ALL),
js AS (SELECT n.conv_id, n.topic_idx, string_agg('{"text":' || CAST(to_json(text) AS VARCHAR) || ',"mass":' || CAST(mass AS VARCHAR) || ',"details":[' || coalesce(ds, '') || ']}', ',' ORDER BY n.sub_idx) AS ss
       FROM nodes n LEFT JOIN jd ON n.conv_id = jd.conv_id AND n.topic_idx = jd.topic_idx AND n.sub_idx = jd.sub_idx WHERE level = 1 GROUP BY ALL)
SELECT n.conv_id, '[' || string_agg('{"text":' || CAST(to_json(text) AS VARCHAR) || ',"mass":' || CAST(mass AS VARCHAR) || ',"subs":[' || coalesce(ss, '') || ']}', ',' ORDER BY n.topic_idx) || ']' AS tree
FROM nodes n LEFT JOIN js ON n.conv_id = js.conv_id AND n.topic_idx = js.topic_idx WHERE level = 0 GROUP BY n.conv_id""")
def tree_json(spark, sf_dir):
    return tree.to_json(nodes(spark, sf_dir))


@query(TREE + "SELECT conv_id, level, text, mass, topic_idx, sub_idx, detail_idx FROM nodes")
def tree_from_json(spark, sf_dir):
    """Every tree written as JSON and read back."""
    return tree.from_json(tree.to_json(nodes(spark, sf_dir)))


@query(TREE + """,
tn AS (SELECT conv_id, created, 0 AS level, topic AS text, min(seq) AS seq FROM facts GROUP BY ALL
  UNION ALL SELECT conv_id, created, 1, sub_topic, min(seq) FROM facts WHERE sub_topic IS NOT NULL GROUP BY ALL
  UNION ALL SELECT conv_id, created, 2, detail, min(seq) FROM facts WHERE detail IS NOT NULL GROUP BY ALL),
tl AS (SELECT c.conv_id, c.created, c.level, c.text, arg_min(p.text, (p.seq, p.text)) AS parent FROM tn c JOIN tn p ON c.conv_id = p.conv_id AND c.created = p.created AND c.level = p.level + 1
       AND CASE c.level WHEN 1 THEN c.text[1] = p.text[1] ELSE contains(lower(c.text), p.text) END GROUP BY ALL)
SELECT tn.conv_id, tn.created, tn.level, tn.text, parent FROM tn LEFT JOIN tl ON tn.conv_id = tl.conv_id AND tn.created = tl.created AND tn.level = tl.level AND tn.text = tl.text""")
def turn_links(spark, sf_dir):
    """Each round trip's nodes linked to each other: sub-topics by their first letter, details by the word they hold."""
    f = facts(spark, sf_dir)
    each = F.array(*[F.struct(F.lit(i).alias("level"), F.col(c).alias("text")) for i, c in enumerate(("topic", "sub_topic", "detail"))])
    n = f.select("conv_id", "created", "seq", F.explode(each).alias("x")).select("conv_id", "created", "seq", "x.*").where("text IS NOT NULL")
    n = n.groupBy("conv_id", "created", "level", "text").agg(F.min("seq").alias("seq")).withColumn("node_id", F.struct("text", "level"))
    belongs = lambda child, parent: F.when(F.col("level") == 1, F.left(child, F.lit(1)) == F.left(parent, F.lit(1))).otherwise(F.contains(F.lower(child), parent))
    return matching.link_within_turn(n, ["conv_id", "created"], belongs).select("conv_id", "created", "level", "text", F.col("parent_id.text").alias("parent"))


@query()
def tree_budgeted_mass(spark, sf_dir):
    return tree.budgeted(nodes(spark, sf_dir), 600, "mass")


@query()
def tree_budgeted_recency(spark, sf_dir):
    return tree.budgeted(nodes(spark, sf_dir), 600, "recency")


@query(TREE + "SELECT conv_id, level, text, topic_idx < 2 AND sub_idx < 3 AND detail_idx < 1 AS fits FROM nodes")
def tree_capacity(spark, sf_dir):
    return tree.with_fit(tree.merge_exact(facts(spark, sf_dir)), (2, 3, 1)).select("conv_id", "level", "text", "fits")


LINES = TREE + """, ln AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY topic_idx, sub_idx, detail_idx) AS INT) AS pos, level, CASE level WHEN 0 THEN 'SN' WHEN 1 THEN 'PN' ELSE 'RN' END AS marker, CASE WHEN level = 1 THEN mass END AS mass, text FROM nodes)
"""
#: A node is one line of a block that is read back: line breaks inside a text become spaces.
FLAT = "replace(text, chr(10), ' ')"


def flat_nodes(spark, sf_dir):
    return nodes(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))


@query(LINES + f"SELECT conv_id, level, marker, mass, {FLAT} AS text FROM ln")
def block_lines(spark, sf_dir):
    flat = flat_nodes(spark, sf_dir)
    return markers.block_lines(tree.render(flat, level_markers=True)).select("conv_id", "level", "marker", "mass", "text")


CARRIED = LINES + """, f AS (SELECT conv_id, pos, level, mass FROM ln),
r AS (SELECT *, sum(CASE WHEN level = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS run FROM f),
c AS (SELECT conv_id, pos, level, CASE level WHEN 1 THEN mass WHEN 2 THEN last_value(CASE WHEN level = 1 THEN mass END IGNORE NULLS) OVER (PARTITION BY conv_id, run ORDER BY pos) END AS within_topic,
        CASE level WHEN 1 THEN mass WHEN 2 THEN last_value(CASE WHEN level = 1 THEN mass END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY pos) END AS across_topics FROM r)
"""  # fmt: skip


@query(CARRIED + "SELECT conv_id, level, count(*) AS n, round(sum(within_topic), 6) AS within_topic, round(sum(across_topics), 6) AS across_topics FROM c GROUP BY conv_id, level")
def inherited_masses(spark, sf_dir):
    flat = flat_nodes(spark, sf_dir)
    lines = markers.block_lines(tree.render(flat, level_markers=True))
    own = markers.inherited_mass(lines, "conv_id").withColumnRenamed("carried", "within_topic")
    both = markers.inherited_mass(own, "conv_id", reset=False).withColumnRenamed("carried", "across_topics")
    return both.groupBy("conv_id", "level").agg(F.count("*").alias("n"), F.round(F.sum("within_topic"), 6).alias("within_topic"), F.round(F.sum("across_topics"), 6).alias("across_topics"))


#: A block in tokens of three characters, so that markers and concepts meet inside tokens.
SPANS = LINES + f""", tx AS (SELECT conv_id, pos, level, coalesce(mass, 0.0) AS mass, repeat('  ', level) || CASE level WHEN 0 THEN '[SN]' WHEN 1 THEN {PN} ELSE '[RN]' END AS head, ' ' || {FLAT} AS said FROM ln),
of AS (SELECT *, CAST(11 + sum(length(head) + length(said) + 1) OVER (PARTITION BY conv_id ORDER BY pos) - length(said) - 2 AS INT) AS f FROM tx),
se AS (SELECT *, f + length(said) AS e FROM of),
ts AS (SELECT conv_id, CAST(pos - 1 AS INT) AS span, level, mass, list_filter(range(f // 3, (e - 1) // 3 + 1), lambda x: NOT (x = f // 3 AND f % 3 > 0 AND trim(said[1:3 - f % 3]) = '') AND NOT (x = (e - 1) // 3 AND e % 3 > 0 AND trim(said[length(said) - e % 3 + 1:]) = '')) AS positions FROM se)
"""


def prompt_spans(spark, sf_dir):
    blocks = tree.render(flat_nodes(spark, sf_dir), level_markers=True)
    return spans.token_spans(blocks.select("conv_id", F.regexp_extract_all("block", F.lit("(?s)(.{1,3})"), 1).alias("pieces")), level_markers=True)


@query(SPANS + "SELECT conv_id, span, level, CAST(mass AS DOUBLE) AS mass, list_transform(positions, lambda x: CAST(x AS INT)) AS positions FROM ts")
def marker_spans(spark, sf_dir):
    return prompt_spans(spark, sf_dir)


@query(SPANS + """, tr AS (SELECT *, sum(CASE WHEN level = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY span) AS run FROM ts),
tm AS (SELECT *, CASE level WHEN 1 THEN mass WHEN 2 THEN last_value(CASE WHEN level = 1 THEN mass END IGNORE NULLS) OVER (PARTITION BY conv_id, run ORDER BY span) END AS m FROM tr)
SELECT conv_id, CAST(unnest(positions) AS INT) AS position, CAST(m AS DOUBLE) AS mass FROM tm WHERE m > 0""")
def marked_positions(spark, sf_dir):
    """Positions of sub-topics and, with their masses, of the details under them."""
    return spans.weighted_positions(prompt_spans(spark, sf_dir), "conv_id", inherit=True)


@query("""
WITH p AS (SELECT conv_id, turn AS pos, CAST(length(coalesce(text, '')) AS DOUBLE) / 100 AS mass FROM conversations), n AS (SELECT conv_id, max(pos) + 2 AS n FROM p GROUP BY conv_id), a AS (SELECT conv_id, pos, max(least(2.0, mass * 0.5)) AS m FROM p WHERE mass > 0 GROUP BY conv_id, pos)
SELECT n.conv_id, list(round(coalesce(a.m, 0.0), 6) ORDER BY i) FILTER (i < n.n) AS vector, list(round(least(1.5, coalesce(a.m, 0.0) * 0.9), 6) ORDER BY i) AS bias FROM (SELECT conv_id, n, unnest(range(0, greatest(n, 4))) AS i FROM n) n LEFT JOIN a ON a.conv_id = n.conv_id AND a.pos = i GROUP BY n.conv_id, n.n""")
def conversation_mass_vectors(spark, sf_dir):
    """Mass and bias at every position of every conversation, short ones filled to 4 keys."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), (F.length(F.coalesce("text", F.lit(""))).cast("double") / 100).alias("mass"))
    n = c.groupBy("conv_id").agg((F.max("pos") + 2).cast("int").alias("n"))
    v = markers.mass_vector(c.join(n, "conv_id"), "conv_id", "pos", "mass", "n", 2.0, 0.5)
    each = n.join(v, "conv_id", "left").withColumn("vector", F.coalesce("vector", F.array_repeat(F.lit(0.0), F.col("n"))))  # without any mass: zeros
    r = lambda a: F.transform(a, lambda x: F.round(x, 6))
    return each.select("conv_id", r(F.col("vector")).alias("vector"), r(markers.mass_bias(F.col("vector"), 0.9, 1.5, F.greatest("n", F.lit(4)))).alias("bias"))
