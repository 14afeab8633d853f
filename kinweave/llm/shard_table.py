"""Sharding by a permutation-filled lookup table.

Every shard orders the slots of a table of prime size by its own offset and step; the shards take
turns, each claiming its next free slot, until the table is full. Slots are even to one per shard, and a
shard that goes away frees its own slots while few others move. A key's hash modulo the size is its
slot; the table (``size`` rows, whatever the data) is broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import fresh

#: A prime, about a thousand times the shards.
SIZE = 65_537
SHARDS = 64


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def fill(shards: list[str], size: int = SIZE) -> list[int]:
    """The table: for each slot the position of its shard in ``shards``."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one, and no more than slots")
    if size < 2 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be prime, so that every step visits all slots")
    at = [_number(s, "offset") % size for s in shards]
    step = [_number(s, "step") % (size - 1) + 1 for s in shards]
    table = [-1] * size
    left = size
    while left:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            table[at[k]] = k
            left -= 1
            if not left:
                break
    return table


def lookup(spark: SparkSession, shards: list[str], size: int = SIZE) -> DataFrame:
    """The table as rows (slot, shard)."""
    taken = F.split(F.lit(",".join(map(str, fill(shards, size)))), ",")
    names = F.split(F.lit("\x1f".join(shards)), "\x1f")
    number = F.element_at(taken, (F.col("id") + 1).cast("int")).cast("int")
    return spark.range(size).select(F.col("id").alias("slot"), F.element_at(names, number + 1).alias("shard"))


def slot_of(doc: str, text: str, size: int = SIZE) -> Column:
    """By the id; rows without one by their text, so that they spread too."""
    key = F.coalesce(F.concat(F.lit("i"), F.col(doc).cast("string")), F.concat(F.lit("t"), F.col(text).cast("string")), F.lit(""))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint") % size


def place(docs: DataFrame, shards: list[str] | None = None, size: int = SIZE, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with a slot and a shard column, whose names are returned too. Every row is kept; rows with
    one id, repeated ones included, share a shard; null ids go by text, and null texts among them together."""
    slot, shard = fresh(docs, "slot", "shard")
    table = lookup(docs.sparkSession, shards or [f"shard-{k:03d}" for k in range(SHARDS)], size)
    table = F.broadcast(table.select(F.col("slot").alias(slot), F.col("shard").alias(shard)))
    placed = docs.withColumn(slot, slot_of(doc, text, size)).join(table, slot)
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], slot, shard), slot, shard


def report(docs: DataFrame) -> DataFrame:
    """doc_id, slot and shard of every document."""
    return place(docs.select("doc_id", "text"))[0].select("doc_id", "slot", "shard")
