"""Sharding by a permutation-filled lookup table (native columns).

Each shard has its own order of preference over the slots of a table of prime
size: it starts at an offset and steps by a skip, both from its name's hash,
which visits every slot once. Shards take turns, each claiming its next free
slot, until the table is full; so slot counts differ by one at most, and when
shards come or go few other slots change hands.

A row's slot is its key's hash modulo the table size. The table has a row per
slot, its size is fixed by a parameter, and it is broadcast: placement costs a
hash and a look-up, with no shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 64
SLOTS = 8209
#: Hash digits used: 60 bits, which fit a long on any engine.
DIGITS = 15


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of the shard that claimed it."""
    if not shards or not is_prime(slots) or slots < len(shards):
        raise ValueError("needs shards, and a prime number of slots that is not below theirs")
    offset = [_hash(f"offset:{s}") % slots for s in shards]
    skip = [_hash(f"skip:{s}") % (slots - 1) + 1 for s in shards] if slots > 2 else [1] * len(shards)
    table, at, free = [-1] * slots, [0] * len(shards), slots
    while True:
        for i in range(len(shards)):
            while table[slot := (offset[i] + at[i] * skip[i]) % slots] >= 0:
                at[i] += 1
            table[slot] = i
            at[i] += 1
            free -= 1
            if not free:
                return table


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard) rows of the filled table."""
    rows = [(slot, shards[i]) for slot, i in enumerate(fill(shards, slots))]
    return spark.createDataFrame(rows, "slot bigint, shard string")


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digits = F.substring(F.md5(key.cast("string")), 1, DIGITS)
    return F.conv(digits, 16, 10).cast("bigint") % slots


def place(docs: DataFrame, shards: list[str], slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with `slot` and `shard`; all rows and other columns stay.

    Rows of null key are placed by their text, so that many of them spread;
    if that is null too, as the empty text. Equal keys share a shard. Columns
    named slot or shard are replaced. An empty table gives no rows.
    """
    docs = docs.drop("slot", "shard")
    chosen = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col(text), F.lit(""))))
    return docs.withColumn("slot", slot_of(chosen, slots)).join(F.broadcast(lookup(docs.sparkSession, shards, slots)), "slot")


def names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]


def write(docs: DataFrame, path: str, shards: list[str], slots: int = SLOTS, **columns: str) -> None:
    """Write a folder for each shard, straight from the placed rows without a shuffle."""
    place(docs, shards, slots, **columns).write.partitionBy("shard").parquet(path)
