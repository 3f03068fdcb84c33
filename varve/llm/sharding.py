"""Placement by a permutation-filled lookup table (as in the Maglev load balancer).

Every shard prefers the slots of a prime-sized table in an order of its own;
shards take turns claiming their next free slot until the table is full. Shards
get equal shares within one slot, and adding or removing a shard moves few
other slots. The table has a fixed number of rows, so it is broadcast: placing
a row is one hash and one lookup.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The size of the table: a prime well above the number of shards.
SLOTS = 65_537


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The index of the shard that owns each slot."""
    if not shards:
        raise ValueError("no shards")
    if any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)) or slots < len(shards):
        raise ValueError("slots has to be a prime and no less than the number of shards")
    offset = [_number(f"offset {s}") % slots for s in shards]
    skip = [_number(f"skip {s}") % (slots - 1) + 1 for s in shards]
    owner, turn, filled = np.full(slots, -1, dtype=np.int32), [0] * len(shards), 0
    while filled < slots:
        for i in range(len(shards)):
            while owner[slot := (offset[i] + turn[i] * skip[i]) % slots] >= 0:
                turn[i] += 1
            owner[slot] = i
            filled += 1
            if filled == slots:
                break
    return owner


def placed(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """key, slot and shard for each row (null key: the empty string).

    Equal keys go to the same shard; a key is never split, so whoever shards
    by a skewed key should add a second column to it. A repeated row repeats
    its result, an empty table gives an empty one. Other columns of `df` are
    not looked at.
    """
    spark = df.sparkSession
    owner = lookup_table(shards, slots)
    table = spark.createDataFrame([(i, shards[o]) for i, o in enumerate(owner.tolist())], "slot long, shard string")
    number = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    return df.select(F.col(key), F.pmod(number, F.lit(slots)).alias("slot")).join(F.broadcast(table), "slot").select(key, "slot", "shard")
