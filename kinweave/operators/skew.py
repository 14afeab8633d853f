"""Equi-join for many-to-many keys of which a few may be very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIRS_PER_TASK = 50_000_000


def salted_join(
    left: DataFrame, right: DataFrame, on: list[str], spread: str, pairs_per_task: int = PAIRS_PER_TASK
) -> DataFrame:
    """Inner join on ``on`` in which no key makes a task produce more than ``pairs_per_task`` pairs.

    Keys are counted on both sides (partial aggregation, so a hot key costs one row per map
    task). A key with too many pairs gets n salts: its left rows are dealt out by a hash of
    ``spread``, its right rows are repeated n times. All other keys keep salt 0.
    """
    counts = (
        left.groupBy(*on)
        .agg(F.count("*").alias("_l"))
        .join(right.groupBy(*on).agg(F.count("*").alias("_r")), on)
        .where(F.col("_l").cast("double") * F.col("_r") > pairs_per_task)
        .select(
            *on,
            F.least(F.col("_l"), F.ceil(F.col("_l").cast("double") * F.col("_r") / F.lit(pairs_per_task)))
            .cast("int")
            .alias("_salts"),
        )
    )
    dealt = left.join(counts, on, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"), F.lit(0))
    )
    repeated = right.join(counts, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    )
    return dealt.drop("_salts").join(repeated.drop("_salts"), [*on, "_salt"]).drop("_salt")
