"""Durable runs: names, checkpoints that a later call goes on from, and kept trees."""

from __future__ import annotations

import json
import secrets
from datetime import UTC, datetime
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields in which a checkpoint and the run that goes on from it must agree.
IDENTITY = ["arm", "w", "inject", "corpus_sha256", "questions_sha256"]


def new_run_id() -> str:
    """UTC time and six random hex digits."""
    return f"{datetime.now(UTC):%Y%m%dT%H%M%SZ}-{secrets.token_hex(3)}"


def of_run(path: str, run_id: str) -> str:
    """data/calls.jsonl and r1 give data/calls.r1.jsonl."""
    p = PurePosixPath(path)
    return str(p.with_name(f"{p.stem}.{run_id}{p.suffix}"))


def cell_name(arm: str, w: float, inject: str, prefill_scale: float = 0.0) -> str:
    """Name of a cell of the grid, fit for a file system; different cells have different names."""
    middle = [inject.replace("+", "-")] if w > 0 else []
    last = [f"pf{prefill_scale:g}"] if prefill_scale > 0 else []
    return "__".join([arm, f"w{w:g}", *middle, *last])


def weight_grid(raw: str) -> list[float]:
    """Different weights of a list like "0,0.05,0.2", ascending."""
    out = sorted({float(x) for x in raw.split(",") if x.strip()})
    if not out or out[0] < 0:
        raise ValueError("the grid needs at least one weight, and none below 0")
    return out


def corpus_digest(trips: DataFrame, group: str, order: str, fields: list[str]) -> DataFrame:
    """(group, sha256): digest of each group's rows as JSON, by the digests of its rows in order.

    Rows are hashed where they are; what meets in a group are 64 characters a row.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)
    each = trips.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), row.alias("h")))).alias("rows"))
    return each.select(group, F.sha2(F.array_join(F.col("rows.h"), ","), 256).alias("sha256"))


def start_checkpoint(spark: SparkSession, path: str, header: dict, resume: bool = False) -> None:
    """Open the folder of a run: write its header, or check that the header there is the same run's.

    A folder that is there already is refused unless ``resume`` is given, and then its
    header must agree in every field of IDENTITY.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/header")
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    if not there:
        if resume:
            raise ValueError("resume refused: no header")
        spark.createDataFrame([(json.dumps(header, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/header")
        return
    if not resume:
        raise ValueError(f"{path} holds a run already")
    known = json.loads(spark.read.text(f"{path}/header").first()["value"])
    for field in IDENTITY:
        if known.get(field) != header.get(field):
            raise ValueError(f"resume refused: {field} is {known.get(field)!r} there and {header.get(field)!r} here")


def append_answers(answers: DataFrame, path: str) -> None:
    """Add answers (qid, answer, ...) to a run, as JSON lines; a task that runs again adds nothing twice."""
    answers.withColumn("at", F.current_timestamp()).write.mode("append").json(f"{path}/answers")


def answers_of(spark: SparkSession, path: str, kind: str = "qid string, answer string") -> DataFrame:
    """The last answer of each question of a run; none for a run without answers."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/answers")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], kind)
    rows = spark.read.schema(f"{kind}, at timestamp").json(f"{path}/answers")
    own = [c for c in rows.columns if c != "at"]
    return rows.groupBy("qid").agg(F.max_by(F.struct(*own), "at").alias("r")).select("r.*")


def still_open(questions: DataFrame, path: str) -> DataFrame:
    """Questions of a run that have no answer yet."""
    return questions.join(answers_of(questions.sparkSession, path).select("qid"), "qid", "left_anti")


def save_trees(nodes: DataFrame, path: str, round_trips: int) -> None:
    """Keep trees and the number of round trips; a reader sees the old ones or the new ones, by the folder's name."""
    nodes.write.mode("overwrite").parquet(f"{path}/round_trips={round_trips}")


def load_trees(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The trees kept last and their number of round trips."""
    rows = spark.read.parquet(path)
    last = rows.agg(F.max("round_trips")).first()[0] or 0
    return rows.where(F.col("round_trips") == last).drop("round_trips"), last


TREE = "array<struct<sun:struct<node_id:string,text:string,created_turn:bigint>,planets:array<struct<planet:struct<node_id:string,text:string,created_turn:bigint>,satellites:array<struct<node_id:string,text:string,created_turn:bigint>>>>>>"


def tree_records(trees: DataFrame, group: str, text: str) -> DataFrame:
    """Records (conv_id, node_id, parent_id, level, text, created, seq) of nested trees in JSON (``suns``)."""
    suns = trees.select(F.col(group).alias("conv_id"), F.posexplode(F.from_json(F.get_json_object(text, "$.suns"), TREE)).alias("i", "s"))
    planets = suns.select("conv_id", F.col("s.sun.node_id").alias("up"), F.posexplode("s.planets").alias("i", "p"))
    satellites = planets.select("conv_id", F.col("p.planet.node_id").alias("up"), F.posexplode("p.satellites").alias("i", "n"))
    row = lambda n, up, level: ["conv_id", F.col(f"{n}.node_id").alias("node_id"), up, F.lit(level).alias("level"), F.col(f"{n}.text").alias("text"), F.col(f"{n}.created_turn").alias("created"), F.col("i").cast("bigint").alias("seq")]
    return suns.select(*row("s.sun", F.lit(None).cast("string").alias("parent_id"), 0)).unionByName(planets.select(*row("p.planet", F.col("up").alias("parent_id"), 1))).unionByName(satellites.select(*row("n", F.col("up").alias("parent_id"), 2)))


def bias_counters(layers: Column, completion_tokens: Column, prefills: Column, prefill_scale: Column, last_row: Column) -> Column:
    """What a reader's counters must show: applied, skipped in prefill, skipped sliding, applied in the last prefill's row."""
    decodes = F.greatest(completion_tokens - 1, F.lit(0))
    scaled = prefill_scale > 0
    return F.struct(
        (layers * (decodes + F.when(scaled, prefills).otherwise(0))).alias("applied"), F.when(scaled, 0).otherwise(layers * prefills).alias("skipped_prefill"),
        F.lit(0).alias("skipped_sliding"), F.when(last_row, layers).otherwise(0).alias("applied_last_row"),
    )


def degenerate(text: Column) -> Column:
    """Blank, or six words and more of two different ones at most."""
    return F.get(F.transform(F.array(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")), lambda ws: (F.size(ws) == 0) | ((F.size(ws) >= 6) & (F.size(F.array_distinct(ws)) <= 2))), 0)
