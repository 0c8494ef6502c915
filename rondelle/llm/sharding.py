"""Sharding (native): a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Production parameters: a prime number of slots, well over 100 for each shard.
SHARDS = 64
SLOTS = 16_381


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Shard number of each slot.

    Each shard prefers the slots of a permutation (offset + k * skip) mod slots
    taken from a digest of its name. Shards take turns claiming their most
    preferred free slot, so all get as many slots, one more or less, and a
    shard that goes leaves most other slots where they were. slots is prime.
    """
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must have different names, and there must be one at least")
    digest = [hashlib.md5(s.encode()).hexdigest() for s in shards]
    place = [int(d[:15], 16) % slots for d in digest]
    skip = [int(d[15:30], 16) % (slots - 1) + 1 for d in digest]
    table, claimed = [-1] * slots, 0
    while True:
        for i in range(len(shards)):
            while table[place[i]] >= 0:
                place[i] = (place[i] + skip[i]) % slots
            table[place[i]] = i
            claimed += 1
            if claimed == slots:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 60 bits of the MD5 of its text, mod slots; null keys count as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint") % slots


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """Adds the slot and the shard's name to each row.

    The table has ``slots`` rows, whatever the data are, and goes to all
    executors; a row costs one hash and one lookup, and nothing is shuffled.
    All rows of a key land in one shard: shard by a key without hot values (an
    id). Null keys share the slot of the empty text; repeated rows stay; an
    empty table gives an empty result. Existing columns of the added names are
    replaced.
    """
    spark = df.sparkSession
    names = [shards[i] for i in lookup_table(shards, slots)]
    table = spark.sql("SELECT posexplode(from_json(:names, 'array<string>')) AS (_slot, _shard)", args={"names": json.dumps(names)})
    rows = df.drop(slot, shard).withColumn(slot, slot_of(F.col(key), slots))
    return rows.join(F.broadcast(table), F.col(slot) == F.col("_slot"), "left").withColumnRenamed("_shard", shard).drop("_slot")


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]
