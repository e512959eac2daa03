"""Sharding by a permutation-filled lookup table: shards take turns claiming slots of a prime-sized table.

Each shard walks its own permutation of the slots, (offset + i * skip) mod size, and claims the first free one when its
turn comes. The table has a fixed number of slots whatever the data, so it is broadcast; a key's slot is its hash modulo
the size, and placement is one lookup. Removing a shard moves few keys of the others.

Null keys go where the hash of null goes. Extra columns stay; those named _slot or _shard become _slot_0 and _shard_0. An empty input gives an empty output. Rows with equal keys go to one shard, by design; give a finer
key (or several columns) where a single key's rows must spread.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import make_way

#: A prime well above a hundred slots for each shard keeps shards within about one per cent of even.
SLOTS = 65_537
SHARDS = 64


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot, the position in `shards` of its owner. Takes slots * log(slots) steps or so on the driver."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct, and at least one")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("the number of slots must be a prime, not below the number of shards")
    walks = []
    for name in shards:
        d = hashlib.sha256(name.encode()).digest()
        walks.append([int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1])
    owner, left = [-1] * slots, slots
    while left:
        for i, walk in enumerate(walks):
            while owner[walk[0]] >= 0:
                walk[0] = (walk[0] + walk[1]) % slots
            owner[walk[0]] = i
            left -= 1
            if not left:
                break
    return owner


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(_slot, _shard), from a literal list of owners."""
    owners = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",").cast("array<int>")
    return spark.range(1).select(F.posexplode(owners).alias("_slot", "_shard"))


def slot_of(*key, slots: int = SLOTS):
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def place(df: DataFrame, key: list[str], shards: list[str], slots: int = SLOTS) -> DataFrame:
    """`df` with _slot and _shard. The broadcast side has `slots` rows, a parameter and not a property of the data."""
    df = make_way(df, "__slot").withColumn("__slot", slot_of(*key, slots=slots))
    found = make_way(df, "_slot", "_shard").withColumnRenamed("__slot", "_slot")
    return found.join(F.broadcast(lookup(df.sparkSession, shards, slots)), "_slot")


def write_shards(df: DataFrame, key: list[str], shards: list[str], path: str, files_per_shard: int = 8, slots: int = SLOTS) -> None:
    """One folder a shard. Rows of a shard are spread over `files_per_shard` tasks by slot, so no task has a whole shard."""
    placed = place(make_way(df, "_file"), key, shards, slots).withColumn("_file", F.pmod(F.col("_slot"), F.lit(files_per_shard)))
    out = placed.repartition(F.col("_shard"), F.col("_file")).drop("_file", "_slot")
    out.write.mode("overwrite").partitionBy("_shard").parquet(path)


def sharded(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    placed = place(docs.select("doc_id"), ["doc_id"], [f"shard-{i:05d}" for i in range(shards)], slots)
    return placed.select("doc_id", F.col("_slot").alias("slot"), F.col("_shard").alias("shard"))
