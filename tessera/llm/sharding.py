"""Sharding by a permutation-filled lookup table, with DataFrame functions only.

Each shard has a preference order of the slots of a prime-sized table, a permutation given by an offset
and a stride (Eisenbud et al. 2016). The shards take turns, each claiming the first slot of its order that
is free, until the table is full; so the shards' numbers of slots differ by one at most, and few slots
change hands when a shard comes or goes. The table is a constant of bounded size, made once; a document's
slot is a hash of its key, and its shard is looked up in constant time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._pack import fresh

SLOTS = 65_537
#: Slots beyond which a table isn't broadcast any more.
MOST_SLOTS = 1 << 20
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}{name}".encode()).hexdigest()[:12], 16)


def fill_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of its shard. slots: a prime, and more than there are shards."""
    if not 0 < len(shards) < slots <= MOST_SLOTS or len(set(shards)) < len(shards) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("shards must be different names, fewer than the slots, and slots a prime of bounded size")
    at = [_number(s, "offset") % slots for s in shards]
    stride = [_number(s, "stride") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + stride[k]) % slots
            table[at[k]] = k
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long") % slots).cast("int")


def lookup(spark: SparkSession, table: Sequence[int]) -> DataFrame:
    """(slot, shard) made of the table by SQL functions."""
    return spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, table))), ","))).select(F.col("pos").alias("slot"), F.col("col").cast("int").alias("shard"))


def assign_shards(docs: DataFrame, id_col: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS, slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """docs, all columns, with slot and shard (the shard's index); columns of these names are replaced.

    Every row gets a shard: a null key counts as an empty text, rows that repeat a key go to the same shard.
    An empty table gives no rows.
    """
    own = [c for c in docs.columns if c.lower() not in (slot_name.lower(), shard_name.lower())]
    at, slot, shard = (fresh(docs, name) for name in ("at", "__slot", "__shard"))
    table = lookup(docs.sparkSession, fill_table(shards, slots)).select(F.col("slot").alias(slot), F.col("shard").alias(shard))
    placed = docs.select(*own, slot_of(F.col(id_col), slots).alias(at))
    joined = placed.join(F.broadcast(table), F.col(at) == F.col(slot))  # at most MOST_SLOTS rows of two integers
    return joined.select(*own, F.col(at).alias(slot_name), F.col(shard).alias(shard_name))
