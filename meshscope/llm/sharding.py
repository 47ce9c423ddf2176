"""Sharding by a permutation-filled lookup table.

The table has a prime number of slots.  Every shard prefers the slots in an
order of its own (an offset and a skip derived from its name); the shards take
turns, each claiming its next preferred slot that is still free, until the table
is full.  A heavier shard takes more turns.  A key's shard is the one at slot
``hash(key) mod slots``.  Adding or removing a shard moves few other keys.

The table (its size is a parameter, not a function of the data) is broadcast; a
row is placed by one look-up and is not shuffled.  Rows are handled with
DataFrame functions only.

Defined results: a null key is placed like an empty string; equal keys share a
shard; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshscope.llm.common import column

SLOTS = 65_537  # prime
HASH_DIGITS = 15  # hexadecimal digits of the key's MD5: 60 bits


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode("utf-8")).hexdigest()[:HASH_DIGITS], 16)


def fill_table(shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> list[int]:
    """Index of the shard at each slot."""
    if not _is_prime(slots):
        raise ValueError("the number of slots must be prime, so that every order visits every slot")
    weights = weights or [1] * len(shards)
    if not shards or len(set(shards)) < len(shards) or len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("shards need distinct names and a weight of 1 or more each")
    if sum(weights) > slots:
        raise ValueError("there must be at least as many slots as turns in a round")
    place = [_number(f"offset:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while free:
        for k, turns in enumerate(weights):
            for _ in range(min(turns, free)):
                while table[place[k]] >= 0:
                    place[k] = (place[k] + skip[k]) % slots
                table[place[k]] = k
                free -= 1
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The key's slot: 60 bits of the MD5 of its text, modulo the number of slots."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, HASH_DIGITS)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(slots)).cast("int")


def table_frame(spark: SparkSession, shards: list[str], table: list[int]) -> DataFrame:
    """(slot, shard): one row for each slot."""
    names = F.array(*[F.lit(s) for s in shards])
    listed = F.split(F.lit(",".join(map(str, table))), ",")
    return spark.range(1).select(F.posexplode(listed).alias("slot", "k")).select(
        "slot", F.element_at(names, F.col("k").cast("int") + 1).alias("shard")
    )


def place(
    docs: DataFrame,
    shards: list[str],
    key_col: str = "doc_id",
    slots: int = SLOTS,
    weights: list[int] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """``row`` (the kept columns), ``slot`` and ``shard`` of each row."""
    keep = list(docs.columns if keep is None else keep)
    looked_up = table_frame(docs.sparkSession, shards, fill_table(shards, slots, weights))
    keyed = docs.select(
        F.struct(*[column(c) for c in keep]).alias("row"), slot_of(column(key_col), slots).alias("slot")
    )
    # one row per slot: bounded by the parameter ``slots``
    return keyed.join(F.broadcast(looked_up), "slot").select("row", "slot", "shard")
