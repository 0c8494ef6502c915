"""Three-level topic trees: build, masses, coordinates, rendering, budgets.

A tree is a table ``nodes``: conv_id, node_id, parent_id, level (0 topic, 1
sub-topic, 2 detail), text, created, seq (order among siblings), topic_id and
sub_id (ancestors).
"""

from __future__ import annotations

import heapq
import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Limits on topics, sub-topics of a topic, details of a sub-topic.
CAPACITY = (10_000, 1_000, 1_000)
#: Masses of a level that has nothing below it.
DEFAULTS = (1.0, 0.5, 0.1)


def merge_exact(facts: DataFrame) -> DataFrame:
    """Merge facts (conv_id, created, seq, topic, sub_topic, detail) into trees when equal texts match.

    What arrives first stays and later repeats are dropped, level by level under
    the same parent, so the order-dependent fold is a distinct with the first
    arrival kept: one aggregation over the three prefixes of each fact's path.
    Node ids are digests of the path; topic_id and sub_id name a node's
    ancestors (and itself), so that no later step needs a self-join.
    """
    none = F.lit(None).cast("string")
    t, s, d = F.col("topic"), F.col("sub_topic"), F.col("detail")
    prefix = F.array(
        F.struct(F.lit(0).alias("level"), t.alias("t"), none.alias("s"), none.alias("d")),
        F.struct(F.lit(1).alias("level"), t.alias("t"), s.alias("s"), none.alias("d")),
        F.struct(F.lit(2).alias("level"), t.alias("t"), s.alias("s"), d.alias("d")),
    )
    whole = F.filter(prefix, lambda x: x["t"].isNotNull() & ((x["level"] < 1) | x["s"].isNotNull()) & ((x["level"] < 2) | x["d"].isNotNull()))
    found = facts.select("conv_id", "created", "seq", F.explode(whole).alias("x")).groupBy("conv_id", "x").agg(F.min(F.struct("created", "seq")).alias("_first"))
    path = lambda *c: F.substring(F.sha1(F.concat_ws("\x1f", F.col("conv_id").cast("string"), *[F.col(f"x.{k}") for k in c]).cast("binary")), 1, 12)
    level = F.col("x.level")
    out = found.select("conv_id", level.alias("level"), path("t").alias("topic_id"), F.when(level > 0, path("t", "s")).alias("sub_id"), F.when(level > 1, path("t", "s", "d")).alias("_d"), F.coalesce(F.when(level == 2, F.col("x.d")), F.when(level == 1, F.col("x.s")), F.col("x.t")).alias("text"), F.col("_first.created").alias("created"), F.col("_first.seq").alias("seq"))
    return out.select("conv_id", F.coalesce("_d", "sub_id", "topic_id").alias("node_id"), F.when(F.col("level") == 2, F.col("sub_id")).when(F.col("level") == 1, F.col("topic_id")).alias("parent_id"), "level", "text", "created", "seq", "topic_id", "sub_id")


def with_ancestors(records: DataFrame) -> DataFrame:
    """Adds topic_id and sub_id to records (conv_id, node_id, parent_id, level, ...); those with a missing or wrong parent go."""
    up = lambda level: records.where(F.col("level") == level).select(F.col("conv_id").alias("_c"), F.col("node_id").alias("_n"), F.col("parent_id").alias("_up"))
    on = (F.col("conv_id") == F.col("_c")) & (F.col("parent_id") == F.col("_n"))
    topics = records.where("level = 0").withColumn("topic_id", F.col("node_id")).withColumn("sub_id", F.lit(None).cast("string"))
    subs = records.where("level = 1").join(up(0), on).withColumn("topic_id", F.col("parent_id")).withColumn("sub_id", F.col("node_id"))
    sound = subs.select(F.col("conv_id").alias("_c"), F.col("node_id").alias("_n"), F.col("topic_id").alias("_t"))
    details = records.where("level = 2").join(sound, on).withColumn("topic_id", F.col("_t")).withColumn("sub_id", F.col("parent_id"))
    cols = [*records.columns, "topic_id", "sub_id"]
    return topics.select(cols).unionByName(subs.select(cols)).unionByName(details.select(cols))


def _of(*keys: str):
    return W.partitionBy("conv_id", *keys)


def _turn() -> Column:
    return F.row_number().over(_of("level", "parent_id").orderBy("created", "seq", "node_id"))


def with_fit(nodes: DataFrame, capacity: tuple[int, int, int] = CAPACITY) -> DataFrame:
    """Adds ``fits``: false for nodes beyond the level's limit under their parent, in order of arrival, and for their subtrees."""
    most = F.element_at(F.array(*map(F.lit, capacity)), F.col("level") + 1)
    n = nodes.repartition("conv_id").withColumn("_fits", _turn() <= most)
    topic = F.max(F.when(F.col("level") == 0, F.col("_fits"))).over(_of("topic_id"))
    sub = F.max(F.when(F.col("level") == 1, F.col("_fits"))).over(_of("sub_id"))
    # topics have no sub-topic; said without their level, as a later filter on levels may run after the check
    n = n.withColumn("_topic", topic).withColumn("_sub", F.coalesce(sub, F.lit(True)))
    return n.select(*nodes.columns, F.expr("_fits AND _topic AND _sub").alias("fits"))


def within_capacity(nodes: DataFrame, capacity: tuple[int, int, int] = CAPACITY) -> DataFrame:
    """The nodes, if all fit; a tree that is too large for its limits fails the query rather than losing nodes."""
    said = F.concat(F.lit("tree is full: conversation "), F.col("conv_id").cast("string"), F.lit(", node "), F.col("node_id"))
    return with_fit(nodes, capacity).where(F.when(F.col("fits"), F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))).select(*nodes.columns)


def with_mass(nodes: DataFrame, floor: float = 1.0, defaults: tuple[float, float, float] = DEFAULTS) -> DataFrame:
    """Adds mass: a sub-topic's is its number of details (the floor at least), a topic's the sum of its sub-topics' or its default.

    Windows within a conversation; all of them are served by one shuffle on it.
    """
    details = F.count(F.when(F.col("level") == 2, 1)).over(_of("sub_id"))
    own = nodes.withColumn("_m", F.when(F.col("level") == 1, F.greatest(F.lit(float(floor)), details.cast("double"))).when(F.col("level") == 2, F.lit(defaults[2])))
    total = F.sum(F.when(F.col("level") == 1, F.col("_m"))).over(_of("topic_id"))
    return own.withColumn("_t", total).select(*nodes.columns, F.when(F.col("level") == 0, F.coalesce("_t", F.lit(defaults[0]))).otherwise(F.col("_m")).alias("mass"))


def with_coordinates(nodes: DataFrame) -> DataFrame:
    """Adds topic_idx, sub_idx, detail_idx: places among siblings, -1 above; sorted, they are the tree from top to bottom."""
    n = nodes.withColumn("_at", _turn() - 1)
    topic = F.max(F.when(F.col("level") == 0, F.col("_at"))).over(_of("topic_id"))
    sub = F.max(F.when(F.col("level") == 1, F.col("_at"))).over(_of("sub_id"))
    n = n.withColumn("topic_idx", topic).withColumn("_s", sub)
    return n.select(*nodes.columns, "topic_idx", F.when(F.col("level") == 0, -1).otherwise(F.col("_s")).alias("sub_idx"), F.when(F.col("level") == 2, F.col("_at")).otherwise(-1).alias("detail_idx"))


def mass_text(mass: Column) -> Column:
    """One decimal, half to even."""
    return F.bround(mass, 1).cast("decimal(18,1)").cast("string")


def node_line(level: Column, mass: Column, text: Column, level_markers: bool = False) -> Column:
    plain = F.concat(F.lit("[PN"), mass_text(mass), F.lit("]"))
    marker = F.when(level == 0, F.lit("[SN]")).when(level == 1, plain).otherwise(F.lit("[RN]")) if level_markers else plain
    return F.concat(F.repeat(F.lit("  "), level), marker, F.lit(" "), text)


def render(nodes: DataFrame, level_markers: bool = False) -> DataFrame:
    """conv_id, block: all nodes with mass and coordinates as indented lines inside a context tag."""
    line = F.struct("topic_idx", "sub_idx", "detail_idx", node_line(F.col("level"), F.col("mass"), F.col("text"), level_markers).alias("line"))
    lines = nodes.groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("_l"))
    return lines.select("conv_id", F.concat(F.lit("<CONTEXT>\n"), F.array_join(F.col("_l.line"), "\n"), F.lit("\n</CONTEXT>")).alias("block"))


def to_json(nodes: DataFrame) -> DataFrame:
    """conv_id, tree: topics with their sub-topics with their details, as JSON."""
    d = nodes.where("level = 2").groupBy("conv_id", F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("detail_idx").alias("at"), "text"))).alias("details"))
    s = nodes.where("level = 1").join(d, ["conv_id", "node_id"], "left").select("conv_id", "parent_id", F.struct(F.col("sub_idx").alias("at"), "text", "mass", F.coalesce(F.col("details.text"), F.array().cast("array<string>")).alias("details")).alias("s"))
    s = s.groupBy("conv_id", F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list("s")).alias("subs"))
    t = nodes.where("level = 0").join(s, ["conv_id", "node_id"], "left").select("conv_id", F.struct(F.col("topic_idx").alias("at"), "text", "mass", F.coalesce(F.transform("subs", lambda x: F.struct(x["text"].alias("text"), x["mass"].alias("mass"), x["details"].alias("details"))), F.array().cast("array<struct<text:string,mass:double,details:array<string>>>")).alias("subs")).alias("t"))
    t = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("topics"))
    return t.select("conv_id", F.to_json(F.transform("topics", lambda x: F.struct(x["text"].alias("text"), x["mass"].alias("mass"), x["subs"].alias("subs")))).alias("tree"))


#: A tree as to_json writes it.
JSON_TREE = "array<struct<text: string, mass: double, subs: array<struct<text: string, mass: double, details: array<string>>>>>"


def from_json(trees: DataFrame, defaults: tuple[float, float, float] = DEFAULTS) -> DataFrame:
    """The nodes of trees (conv_id, tree) that to_json wrote: conv_id, level, text, mass and coordinates.

    Details have the default mass. A tree that is no JSON of this form fails the
    query; null and an empty one have no nodes.
    """
    read = F.from_json("tree", JSON_TREE, {"mode": "FAILFAST"})
    t = trees.select("conv_id", F.posexplode(read).alias("topic_idx", "t"))
    s = t.select("conv_id", "topic_idx", F.posexplode("t.subs").alias("sub_idx", "s"))
    d = s.select("conv_id", "topic_idx", "sub_idx", F.posexplode("s.details").alias("detail_idx", "text"))
    none = F.lit(-1)
    return (
        t.select("conv_id", F.lit(0).alias("level"), "t.text", "t.mass", "topic_idx", none.alias("sub_idx"), none.alias("detail_idx"))
        .unionByName(s.select("conv_id", F.lit(1).alias("level"), "s.text", "s.mass", "topic_idx", "sub_idx", none.alias("detail_idx")))
        .unionByName(d.select("conv_id", F.lit(2).alias("level"), "text", F.lit(defaults[2]).alias("mass"), "topic_idx", "sub_idx", "detail_idx"))
    )


def metrics(nodes: DataFrame) -> DataFrame:
    """Counts by level, share of topics without sub-topics, and normalised entropy of the masses."""
    by = [F.count(F.when(F.col("level") == i, 1)).alias(n) for i, n in enumerate(("topics", "sub_topics", "details"))]
    share = nodes.withColumn("_p", F.col("mass") / F.sum("mass").over(W.partitionBy("conv_id")))
    base = share.groupBy("conv_id").agg(*by, F.count("*").alias("nodes"), (-F.sum(F.col("_p") * F.log(F.col("_p") + 1e-12))).alias("_h"))
    parents = nodes.where("level = 1").select("conv_id", F.col("parent_id").alias("node_id")).distinct()
    bare = nodes.where("level = 0").join(parents, ["conv_id", "node_id"], "left_anti").groupBy("conv_id").agg(F.count("*").alias("_bare"))
    out = base.join(bare, "conv_id", "left")
    return out.select("conv_id", "topics", "sub_topics", "details", F.round(F.col("details") / F.greatest(F.col("nodes"), F.lit(1)), 6).alias("depth_ratio"), F.round(F.coalesce("_bare", F.lit(0)) / F.col("topics"), 6).alias("bare_topics"), F.round(F.when(F.col("nodes") > 1, F.col("_h") / F.log("nodes")).otherwise(0.0), 6).alias("entropy"))


def level_ties_up(c: Column, i: Column, d: Column) -> Column:
    return F.when((c >= i) & (c >= d), 0).when(i >= d, 1).otherwise(2)


def level_ties_down(c: Column, i: Column, d: Column) -> Column:
    return F.when((c <= 0) & (i <= 0) & (d <= 0), 2).when((d >= i) & (d >= c), 2).when(i >= c, 1).otherwise(0)


def level_of_axes(c: Column, i: Column, d: Column) -> Column:
    return F.when(d, 2).when(i, 1).when(c, 0).otherwise(2)


def choose(rows: list[dict], budget: int, policy: str, cost: Callable[[str], int], seed: int = 0) -> list[bool]:
    """Which of a tree's rows (in tree order) fit a budget, parents before children.

    The first candidate by policy that fits is kept, and its children are
    candidates from then on. What does not fit never will, as the budget only
    shrinks, so rows pass a heap once. The random policy shuffles the
    candidates anew after each row that it keeps.
    """
    if policy not in ("mass", "recency", "random"):
        raise ValueError(f"unknown policy {policy!r}")
    spent = cost("<CONTEXT>\n</CONTEXT>")
    if spent > budget:
        raise ValueError(f"budget {budget} is under the wrapper's {spent}")
    kept, children, costs = [False] * len(rows), {}, [cost("\n" + r["line"]) for r in rows]
    for i, r in enumerate(rows):
        children.setdefault(r["parent_id"], []).append(i)
    if policy != "random":
        rank = lambda i: (-rows[i]["mass"] if policy == "mass" else 0, -rows[i]["created"], i)
        heap = [rank(i) for i in children.get(None, [])]
        heapq.heapify(heap)
        while heap:
            i = heapq.heappop(heap)[-1]
            if spent + costs[i] <= budget:
                kept[i], spent = True, spent + costs[i]
                for c in children.get(rows[i]["node_id"], []):
                    heapq.heappush(heap, rank(c))
        return kept
    rng, open_ = random.Random(seed), children.get(None, [])
    while True:
        order = sorted(open_)
        rng.shuffle(order)
        found = next((i for i in order if spent + costs[i] <= budget), None)
        if found is None:
            return kept
        kept[found], spent = True, spent + costs[found]
        open_ = [i for i in open_ if i != found] + children.get(rows[found]["node_id"], [])


def budgeted(nodes: DataFrame, budget: int, policy: str = "mass", seed: int = 0) -> DataFrame:
    """conv_id, block: the tree cut to at most ``budget`` characters; the cost is additive over lines.

    A greedy choice over one tree at a time; trees are bounded by CAPACITY.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["topic_idx", "sub_idx", "detail_idx"])
        kept = choose(pdf.where(pdf.notna(), None).to_dict("records"), budget, policy, len, seed)
        return pd.DataFrame({"conv_id": [pdf["conv_id"].iloc[0]], "block": ["\n".join(["<CONTEXT>", *pdf["line"][kept], "</CONTEXT>"])], "kept": [sum(kept)]})

    lines = nodes.withColumn("line", node_line(F.col("level"), F.col("mass"), F.col("text")))
    return lines.groupBy("conv_id").applyInPandas(pick, "conv_id bigint, block string, kept bigint")


