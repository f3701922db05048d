"""Placement of keys on shards by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size:
start + turn * step, modulo the size. Shards take turns; at a turn a shard claims the
first slot of its order that is still free. All shards so own nearly the same number of
slots, and when one leaves or joins, few slots change hands between the others. A
key is hashed to a slot; the table is a broadcast lookup, so placing one more row is
one hash and one probe, without a shuffle, however hot its key is.

The table is filled on the driver, where its size is a parameter that does not grow
with the data. Rows are placed by DataFrame functions alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], slots: int, weights: Sequence[int] | None = None) -> list[int]:
    """The index of the shard that owns each slot; a shard of weight w takes w turns a round."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one, and no more than the slots")
    if not is_prime(slots):
        raise ValueError("the number of slots must be prime, so that every step visits every slot")
    weights = list(weights or [1] * len(shards))
    if len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("every shard needs a weight of at least 1")
    digests = [hashlib.md5(name.encode()).digest() for name in shards]
    place = [int.from_bytes(d[:8], "big") % slots for d in digests]
    step = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 if slots > 2 else 1 for d in digests]
    owner, free = [-1] * slots, slots
    while True:
        for shard, turns in enumerate(weights):
            for _ in range(turns):
                if not free:
                    return owner
                while owner[place[shard]] >= 0:
                    place[shard] = (place[shard] + step[shard]) % slots
                owner[place[shard]] = shard
                free -= 1


def table_bytes(owner: Sequence[int]) -> bytes:
    """Two bytes a slot, most significant first."""
    return b"".join(o.to_bytes(2, "big") for o in owner)


def lookup_table(spark: SparkSession, shards: Sequence[str], slots: int, weights: Sequence[int] | None = None) -> DataFrame:
    """The table as rows slot, shard: as many as slots, a fixed parameter of at most a few megabytes."""
    packed = F.lit(table_bytes(fill_table(shards, slots, weights)))
    index = F.conv(F.hex(F.substring(packed, (F.col("id") * 2 + 1).cast("int"), F.lit(2))), 16, 10).cast("int")
    names = F.array(*[F.lit(s) for s in shards])
    return spark.range(slots).select(F.col("id").alias("slot"), F.element_at(names, index + 1).alias("shard"))


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key: 60 bits of the MD5 of its text, modulo the slots; a null key counts as an empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(slots).cast("bigint"))


def place(df: DataFrame, key_col: str, shards: Sequence[str], *, slots: int = 65537, weights: Sequence[int] | None = None) -> DataFrame:
    """Each row's key with its slot and shard: columns `key_col`, slot, shard.

    One output row per input row. Rows of equal keys, and all rows of a null key, share a shard. Other
    columns play no part. Up to 65,535 shards.
    """
    if len(shards) > 65535:
        raise ValueError("two bytes a slot hold at most 65,535 shards")
    rows = df.select(F.col(key_col), slot_of(F.col(key_col), slots).alias("_slot"))
    table = lookup_table(df.sparkSession, shards, slots, weights).withColumnRenamed("slot", "_table_slot")
    placed = rows.join(F.broadcast(table), F.col("_slot") == F.col("_table_slot"), "left")
    return placed.select(key_col, F.col("_slot").alias("slot"), "shard")
