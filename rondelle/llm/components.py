"""Connected components of a link table, in DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_folder, stash_at

MOST_ROUNDS = 60


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every linked node; root is the smallest node reachable.

    Alternating large and small stars: each round points a node's larger
    neighbours, then its smaller ones, at the smallest one. Minima are
    pre-aggregated and joined back, so a node with very many links costs a
    split join, not one task. Rounds grow with the logarithm of the longest
    path; each is written to the shared folder. Loops and null ends are left
    out; without links the result is empty.
    """
    first = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}")
    spark = links.sparkSession
    (edges, at), before = stash_at(first.distinct(), "edges"), None
    for _ in range(MOST_ROUNDS):
        after = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if after["n"] == 0 or after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        (edges, at), read = stash_at(small, "edges"), at
        drop_folder(spark, read)  # nothing reads the round before any more
    raise RuntimeError(f"components not settled after {MOST_ROUNDS} rounds")
