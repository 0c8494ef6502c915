"""Readers and writers of dialogue, question, answer, diagram and power files, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHAT = "chat_id string, topic string, sessions array<struct<n:int, date:string, topic:string, turns:array<struct<role:string, content:string>>>>, total_tokens_estimate bigint, total_tokens_tiktoken bigint"
AGENT = "round_trips array<struct<idx:int, human:string, events:array<struct<kind:string, text:string>>>>"
DIAGRAM = "nodes array<struct<node_id:string, text:string, level:string, mass:double, parent_id:string, created_turn:bigint>>"
QUESTIONS = "qid string, source_session int, fact_quote string, question string, gold_short string, tier1_aliases array<string>, excluded boolean, exclusion_reason string, legacy boolean, kind string"
CALLS = "ts double, prompt_tokens bigint, completion_tokens bigint, latency_ms double, retried boolean, chars bigint"


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    """chat_id, session, date, turn, role, text: one row per message."""
    c = spark.read.schema(CHAT).option("multiLine", True).json(path)
    s = c.select("chat_id", F.posexplode("sessions").alias("_s", "s"))
    return s.select("chat_id", F.col("s.n").alias("session"), F.col("s.date").alias("date"), F.posexplode("s.turns").alias("turn", "t")).select("chat_id", "session", "date", "turn", F.col("t.role").alias("role"), F.col("t.content").alias("text"))


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """turn, role, text of a session file of any known shape: a list of turns or {turns: [...]}, under any of the usual keys.

    The first string among content, text, message, body, msg is the text; rows
    without role or text are dropped.
    """
    v = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    shape = "array<struct<role:string, speaker:string, content:string, text:string, message:string, body:string, msg:string>>"
    turns = F.coalesce(F.try_variant_get("v", "$.turns", shape), F.try_variant_get("v", "$.chat_history", shape), F.try_variant_get("v", "$", shape))
    t = v.select(F.posexplode(turns).alias("turn", "t"))
    rows = t.select("turn", F.lower(F.coalesce("t.role", "t.speaker")).alias("role"), F.coalesce("t.content", "t.text", "t.message", "t.body", "t.msg").alias("text"))
    return rows.where("role IS NOT NULL AND text IS NOT NULL")


def parse_exclusions(text: str) -> list[int]:
    """"36,10" -> [10, 36]; "none" or nothing -> []; repeated or negative numbers are an error."""
    if text.strip().lower() in ("", "none"):
        return []
    out = [int(p) for p in text.split(",") if p.strip()]
    if len(set(out)) != len(out) or min(out) < 0:
        raise ValueError(f"repeated or negative round trip in {text!r}")
    return sorted(out)


def read_agent_session(spark: SparkSession, path: str, exclude: list[int] = ()) -> DataFrame:
    """idx, human, events of an agent session without some round trips; excluding what is not there, or everything, is an error."""
    rts = spark.read.schema(AGENT).option("multiLine", True).json(path).select(F.inline("round_trips"))
    if exclude:
        gone = rts.where(F.col("idx").isin(list(exclude))).count()
        if gone != len(exclude):
            raise ValueError(f"{len(exclude)} round trips to leave out, {gone} found")
        rts = rts.where(~F.col("idx").isin(list(exclude)))
    if not rts.limit(1).count():
        raise ValueError("no round trips")
    return rts


def round_trip_texts(rts: DataFrame) -> DataFrame:
    """idx, user_text, assistant_text, flat_text: events as [kind] and text, and all texts in lines."""
    said = F.array_join(F.transform("events", lambda e: F.concat(F.lit("["), e["kind"], F.lit("]\n"), e["text"])), "\n")
    return rts.select("idx", F.col("human").alias("user_text"), said.alias("assistant_text"), F.array_join(F.concat(F.array("human"), F.col("events.text")), "\n").alias("flat_text"))


def read_diagram(spark: SparkSession, path: str) -> DataFrame:
    """Tree records as tree.with_ancestors takes them (one tree: conv_id 0)."""
    n = spark.read.schema(DIAGRAM).option("multiLine", True).json(path).select(F.posexplode("nodes").alias("seq", "n"))
    level = F.when(F.col("n.level") == "sun", 0).when(F.col("n.level") == "planet", 1).otherwise(2)
    return n.select(F.lit(0).cast("bigint").alias("conv_id"), "n.node_id", "n.parent_id", level.alias("level"), "n.text", F.col("n.created_turn").alias("created"), F.col("seq").cast("bigint").alias("seq"), "n.mass")


def read_questions(spark: SparkSession, path: str, subset: str = "all", include_excluded: bool = False, most: int | None = None) -> DataFrame:
    """Questions in file order, of a subset (generated, legacy, else all)."""
    shape = ", ".join(f"{c.split()[0]}:{c.split()[1]}" for c in QUESTIONS.split(", "))
    q = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{shape}>>")).alias("pos", "q")).select("pos", "q.*")
    if subset in ("generated", "legacy"):
        q = q.where(F.coalesce("legacy", F.lit(False)) == (subset == "legacy"))
    if not include_excluded:
        q = q.where(~F.coalesce("excluded", F.lit(False)))
    return q if most is None else q.orderBy("pos").limit(most)


def read_answer_lines(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """condition (file stem), n, answer from lines "A{n}: text"; a later line wins."""
    t = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("condition"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    hit = t.where(F.col("text").rlike(r"^\s*A\d+\s*[:\-]")).select("condition", "line", F.regexp_extract("text", r"^\s*A(\d+)", 1).cast("int").alias("n"), F.trim(F.regexp_extract("text", r"^\s*A\d+\s*[:\-]\s*(.*)$", 1)).alias("answer"))
    hit = hit if most is None else hit.where(F.col("n").between(1, most))
    return hit.groupBy("condition", "n").agg(F.max_by("answer", "line").alias("answer"))


def read_answer_map(spark: SparkSession, path: str) -> DataFrame:
    """condition, qid, answer from {qid: answer} files."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("condition"), F.explode(F.from_json("value", "map<string,string>")).alias("qid", "answer"))


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Last answer of each qid in a JSONL checkpoint, by its place in the file."""
    kind = "kind string, qid string, answer string"
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    rows = lines.where("trim(text) <> ''").select("line", F.from_json("text", kind).alias("r")).select("line", "r.*").where("qid IS NOT NULL")
    return rows.groupBy("qid").agg(F.max_by("answer", "line").alias("answer"))


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Accounting lines of model calls."""
    return spark.read.schema(CALLS).json(path)


def call_totals(calls: DataFrame, per_million: float) -> DataFrame:
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return calls.agg(F.count("*").alias("requests"), s("prompt_tokens"), s("completion_tokens")).withColumn("usd", F.col("prompt_tokens") * per_million / 1e6)


def read_power(spark: SparkSession, path: str) -> DataFrame:
    """ts, watts from power logs: timestamp first, "x W" last; headers, short and odd lines are skipped."""
    f = F.split("value", r"\s*,\s*")
    rows = spark.read.text(path).where(F.size(f) >= 5).select(F.try_to_timestamp(F.get(f, 0), F.lit("yyyy/MM/dd HH:mm:ss.SSS")).alias("ts"), F.expr("try_cast(regexp_replace(split(value, '\\\\s*,\\\\s*')[4], ' *W$', '') AS DOUBLE)").alias("watts"))
    return rows.where("ts IS NOT NULL AND watts IS NOT NULL")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of every file below a folder."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return b.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def cell_fields(name: Column) -> Column:
    """Parts of a run's file name <arm>__w<w>__<inject>__pf<scale>."""
    part = lambda i: F.regexp_extract(name, r"^(.+?)__w([0-9.]+)__(.+?)__pf([0-9.]+)$", i)
    return F.when(name.rlike(r"^.+?__w[0-9.]+__.+?__pf[0-9.]+$"), F.struct(part(1).alias("arm"), part(2).cast("double").alias("w"), part(3).alias("inject"), part(4).cast("double").alias("prefill_scale")))


def arm_fields(name: Column) -> Column:
    """Parts of an arm's name: full, floor, oracle_cd_full, trunc_4x, summary_6x, cd_mass_6x (null if it is none)."""
    pattern = r"^(full|floor|oracle_cd_full|trunc|summary|cd)(?:_(mass|random|recency))?(?:_(\d+(?:\.\d+)?)x)?$"
    p = lambda i: F.when(F.regexp_extract(name, pattern, i) != "", F.regexp_extract(name, pattern, i))
    sound = name.rlike(r"^(?:full|floor|oracle_cd_full|(?:trunc|summary)_\d+(?:\.\d+)?x|cd_(?:mass|random|recency)_\d+(?:\.\d+)?x)$")
    return F.when(sound, F.struct(p(1).alias("kind"), p(2).alias("policy"), p(3).cast("double").alias("ratio")))


def write_scores(scores: DataFrame, path: str, key: str = "cell") -> None:
    """One sorted CSV with a header; scores are a report, one row per cell."""
    scores.orderBy(key).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def questions_before(questions: DataFrame, first_recent: int | None) -> DataFrame:
    """Questions whose fact is older than the window, or that ask for an absent fact."""
    return questions if first_recent is None else questions.where((F.col("kind") == "absent") | (F.col("source_session") < first_recent))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
