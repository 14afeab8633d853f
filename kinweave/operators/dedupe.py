"""First and last row per key.

All of these filter ``row_number() = 1``, which Spark plans with a group limit *before* the
shuffle: a key that holds a third of the rows still sends one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of every key in the given order."""
    column = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(column, F.row_number().over(window)).where(F.col(column) <= n)
    return out if rank else out.drop(column)


def first_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return top_per(df, keys, [F.col(order).asc()])


def latest_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row an upsert leaves behind: the last one written per key."""
    return top_per(df, keys, [F.col(order).desc()])


def ordered_distinct(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Every distinct key with its first position; a map-side combined minimum."""
    return df.groupBy(*keys).agg(F.min(pos).alias(pos))


def dedupe_pairs(pairs: DataFrame, a: str, b: str, order: list[Column]) -> DataFrame:
    """One row per unordered pair; the first in ``order`` stays."""
    keyed = pairs.withColumn("_low", F.least(a, b)).withColumn("_high", F.greatest(a, b))
    return top_per(keyed, ["_low", "_high"], order).drop("_low", "_high")
