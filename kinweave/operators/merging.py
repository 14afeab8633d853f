"""Merging people, undoing it, and following merges to the person that is left."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.firstcome import Relation, first_come, last_links
from kinweave.operators.keyed import upsert
from kinweave.schemas import SOURCE_KEY


@dataclass
class Network:
    """The five tables a merge touches."""

    people: DataFrame
    sources: DataFrame
    aliases: DataFrame
    interactions: DataFrame
    chunks: DataFrame


def live_roots(people: DataFrame) -> DataFrame:
    """(id, root) of every merged-away person; chains of merges are followed to their end."""
    merged = people.where(F.col("merged_into_id").isNotNull()).select("id", "merged_into_id")
    return last_links(merged, "id", "merged_into_id").select("id", "root")


def judge_merges(people: DataFrame, merges: DataFrame) -> DataFrame:
    """``merges`` (pos, tenant_id, winner_id, loser_id) with ``accepted`` and ``reason``.

    Merges count in order of ``pos``: one whose loser or winner an earlier accepted merge took
    away is refused, as are self-merges, unknown people and people merged before.
    """
    known = people.select("tenant_id", "id", "merged_into_id")

    def side(name: str) -> DataFrame:
        return known.select(
            F.col("tenant_id"), F.col("id").alias(f"{name}_id"), F.col("merged_into_id").alias(f"_{name}_into"),
            F.lit(True).alias(f"_{name}_known"),
        )

    looked_up = merges.join(side("winner"), ["tenant_id", "winner_id"], "left").join(
        side("loser"), ["tenant_id", "loser_id"], "left"
    )
    reason = (
        F.when(F.col("winner_id") == F.col("loser_id"), "cannot merge a person into themselves")
        .when(F.col("_winner_known").isNull(), "winner not found")
        .when(F.col("_loser_known").isNull(), "loser not found")
        .when(F.col("_loser_into").isNotNull(), "loser is already merged")
        .when(F.col("_winner_into").isNotNull(), "winner is itself merged away")
    )
    judged = looked_up.select("pos", "tenant_id", "winner_id", "loser_id", reason.alias("reason"))
    possible = judged.where(F.col("reason").isNull()).drop("reason")
    in_order = first_come(possible, [Relation("loser_id", "loser_id"), Relation("winner_id", "loser_id")])
    late = F.when(~F.col("accepted"), "winner or loser was merged away by an earlier merge")
    return judged.where(F.col("reason").isNotNull()).withColumn("accepted", F.lit(False)).unionByName(
        in_order.withColumn("reason", late)
    )


def merge_people(network: Network, merges: DataFrame) -> tuple[Network, DataFrame]:
    """Apply a table of merges; returns the new tables and the verdict per merge."""
    verdicts = judge_merges(network.people, merges)
    accepted = verdicts.where("accepted").select("tenant_id", "loser_id", "winner_id")
    tenants = accepted.select("tenant_id", "loser_id")
    chain = last_links(accepted, "loser_id", "winner_id").join(tenants, "loser_id")
    moves = chain.select("tenant_id", F.col("loser_id").alias("person_id"), "root", "last")

    def repoint(df: DataFrame) -> DataFrame:
        moved = df.join(moves.drop("last"), ["tenant_id", "person_id"], "left")
        return moved.withColumn("person_id", F.coalesce("root", "person_id")).select(*df.columns)

    moved_sources = network.sources.join(moves, ["tenant_id", "person_id"])
    new_aliases = moved_sources.select(
        *SOURCE_KEY,
        F.col("root").alias("person_id"),
        F.lit("manual").alias("decided_by"),
        F.col("last").alias("merged_from_id"),
    )
    tombs = accepted.select("tenant_id", F.col("loser_id").alias("id"), F.col("winner_id").alias("_into"))
    people = (
        network.people.join(tombs, ["tenant_id", "id"], "left")
        .withColumn("merged_into_id", F.coalesce("merged_into_id", "_into"))
        .select(*network.people.columns)
    )
    aliases = upsert(network.aliases, new_aliases.withColumn("pos", F.lit(0)), SOURCE_KEY, "pos")
    return (
        Network(people, repoint(network.sources), aliases, repoint(network.interactions), repoint(network.chunks)),
        verdicts,
    )


def unmerge_people(network: Network, losers: DataFrame) -> tuple[Network, DataFrame]:
    """Give back exactly the records whose alias names the loser; ``losers`` is (tenant_id, loser_id).

    Returns the new tables and (tenant_id, loser_id, accepted, restored_sources).
    """
    merged = network.people.where(F.col("merged_into_id").isNotNull()).select(
        "tenant_id", F.col("id").alias("loser_id"), F.lit(True).alias("_merged")
    )
    asked = losers.select("tenant_id", "loser_id").distinct().join(merged, ["tenant_id", "loser_id"], "left")
    valid = asked.where("_merged").select("tenant_id", "loser_id")
    back = network.aliases.join(
        valid.withColumnRenamed("loser_id", "merged_from_id"), ["tenant_id", "merged_from_id"], "left_semi"
    ).select(*SOURCE_KEY, F.col("merged_from_id").alias("_back"))

    def restore(df: DataFrame) -> DataFrame:
        moved = df.join(back, SOURCE_KEY, "left")
        return moved.withColumn("person_id", F.coalesce("_back", "person_id")).select(*df.columns)

    freed = valid.select("tenant_id", F.col("loser_id").alias("id"), F.lit(True).alias("_freed"))
    none = F.lit(None).cast(network.people.schema["merged_into_id"].dataType)
    people = (
        network.people.join(freed, ["tenant_id", "id"], "left")
        .withColumn("merged_into_id", F.when(F.col("_freed"), none).otherwise(F.col("merged_into_id")))
        .select(*network.people.columns)
    )
    aliases = network.aliases.join(back, SOURCE_KEY, "left_anti")
    restored = back.groupBy("tenant_id", F.col("_back").alias("loser_id")).agg(
        F.count("*").alias("restored_sources")
    )
    report = asked.join(restored, ["tenant_id", "loser_id"], "left").select(
        "tenant_id",
        "loser_id",
        F.coalesce("_merged", F.lit(False)).alias("accepted"),
        F.coalesce("restored_sources", F.lit(0)).alias("restored_sources"),
    )
    return (
        Network(people, restore(network.sources), aliases, restore(network.interactions), restore(network.chunks)),
        report,
    )
