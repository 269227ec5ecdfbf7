"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table (an offset and a step from a
hash of its name); shards take turns to claim the next free slot they prefer. A document's key is hashed to a slot,
so placing it is one look-up in a table of fixed size, which is the only thing broadcast. Shards then hold equal
numbers of slots within one, and adding or removing a shard moves few of the others' slots.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of the table, a prime well over 100 times the shards.
TABLE_SIZE = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard number of each slot. Raises ValueError for a size that isn't prime, no shards, equal names, or more shards than slots."""
    if not is_prime(size):
        raise ValueError(f"the table's size must be prime: {size}")
    if not shards or len(set(shards)) < len(shards) or len(shards) > size:
        raise ValueError("shards need different names, and at most as many as slots")
    at, step = [], []
    for name in shards:
        digest = hashlib.md5(name.encode()).digest()
        at.append(int.from_bytes(digest[:8], "big") % size)
        step.append(int.from_bytes(digest[8:], "big") % (size - 1) + 1)
    table, free = [-1] * size, size
    while True:
        for k in range(len(shards)):
            slot = at[k]
            while table[slot] >= 0:
                slot = (slot + step[k]) % size
            table[slot] = k
            at[k] = (slot + step[k]) % size
            free -= 1
            if not free:
                return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: 60 bits of the MD5 of its text, modulo the table's size."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("long"), F.lit(size))


def shard(docs: DataFrame, shards: list[str], size: int = TABLE_SIZE, key: str = "doc_id", otherwise: str = "text", slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``docs`` with its slot (long) and shard (string), and no shuffle.

    Rows of equal keys share a shard. A null key is placed by ``otherwise``, if ``docs`` has that column, so that
    rows without a key don't all meet in one shard; with both null, by the empty text. Columns of ``docs`` named
    as the two new ones are replaced. An empty input gives an empty result.
    """
    place = F.col(key).cast("string")
    if otherwise in docs.columns:
        place = F.coalesce(place, F.col(otherwise).cast("string"))
    names = docs.sparkSession.createDataFrame([(i, shards[k]) for i, k in enumerate(lookup_table(shards, size))], "__slot int, __shard string")
    kept = [c for c in docs.columns if c not in (slot_col, shard_col)]
    placed = docs.withColumn("__at", slot_of(F.coalesce(place, F.lit("")), size))
    # the table has `size` rows whatever the input, so it can be broadcast
    return placed.join(F.broadcast(names), F.col("__at") == F.col("__slot"), "left").select(*kept, F.col("__at").alias(slot_col), F.col("__shard").alias(shard_col))
