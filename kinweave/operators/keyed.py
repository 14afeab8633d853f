"""Keyed table changes as pure functions: (old snapshot, change) -> new snapshot.

Each is one anti, semi or left join on the key. The change is usually small; AQE then turns the
join into a broadcast one by its measured size and the old snapshot is not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.text import strip
from kinweave.operators.dedupe import first_per, latest_per
from kinweave.schemas import CHUNK_KEY, SOURCE_KEY


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old``; within ``new`` the last write per key wins."""
    last = latest_per(new, key, order).select(*old.columns)
    return old.join(last.select(*key), key, "left_anti").unionByName(last)


def upsert_sources(old: DataFrame, new: DataFrame, order: str = "pos") -> DataFrame:
    return upsert(old, new, SOURCE_KEY, order)


def upsert_interactions(old: DataFrame, new: DataFrame, order: str = "pos") -> DataFrame:
    """As above; a record that comes back is no longer deleted."""
    revived = new.withColumn("deleted_at", F.lit(None).cast(old.schema["deleted_at"].dataType))
    return upsert(old, revived, SOURCE_KEY, order)


def split_unchanged(pending: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts to embed, texts stored already); blank texts are in neither."""
    worded = pending.where(strip("text") != "").withColumn("content_hash", F.sha2("text", 256))
    stored = chunks.select(*CHUNK_KEY)
    return worded.join(stored, CHUNK_KEY, "left_anti"), worded.join(stored, CHUNK_KEY, "left_semi")


def insert_absent(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows to append: keys not stored yet, the first of each key."""
    return first_per(new.join(old.select(*key), key, "left_anti"), key, order)


def apply_deletions(
    interactions: DataFrame, chunks: DataFrame, deleted: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame]:
    """Mark the interactions of deleted base ids, drop their chunks.

    ``deleted`` has (tenant_id, source_type, external_id). Base ids are compared as values, so
    no character in them acts as a wildcard.
    """
    key = ["tenant_id", "source_type", "external_id"]
    gone = deleted.select(*key).distinct()
    kind = interactions.schema["deleted_at"].dataType
    marked = interactions.join(gone.withColumn("_gone", F.lit(True)), key, "left").withColumn(
        "deleted_at", F.when(F.col("_gone"), as_of.cast(kind)).otherwise(F.col("deleted_at"))
    )
    return marked.select(*interactions.columns), chunks.join(gone, key, "left_anti").select(*chunks.columns)


def absent_records(stored: DataFrame, full: DataFrame) -> DataFrame:
    """Base ids a full pull no longer has: the deletions of a full resync."""
    key = ["tenant_id", "source_type", "external_id"]
    return stored.select(*key).distinct().join(full.select(*key), key, "left_anti")
