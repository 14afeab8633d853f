"""Merges, and their undoing, written through the store as commits of their own.

Only the rows of the people concerned are read and written. The aliases stay in the store, so later syncs
bind the moved records to the person that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.merging import Network, merge_people, unmerge_people
from kinweave.schemas import SOURCE_KEY
from kinweave.session import cut_lineage
from kinweave.streaming.store import NetworkStore

WRITER = "merges"
PERSON = ["tenant_id", "person_id"]


def merge_stored(store: NetworkStore, merges: DataFrame, batch: int) -> DataFrame:
    """Apply ``merges`` (pos, tenant_id, winner_id, loser_id) and return the verdict per merge."""
    seen = store.place(WRITER, batch)
    losers = merges.select("tenant_id", F.col("loser_id").alias("person_id")).distinct()
    both = losers.union(merges.select("tenant_id", "winner_id")).distinct()
    moved = {name: cut_lineage(store.current(name, seen).join(losers, PERSON, "left_semi")) for name in ("sources", "interactions", "chunks")}
    people = cut_lineage(store.current("people", seen, both.withColumnRenamed("person_id", "id"), ["tenant_id", "id"]))
    after, verdicts = merge_people(Network(people, aliases=store.current("aliases", seen).where("false"), **moved), merges)
    _write(store, after, batch)
    verdicts = cut_lineage(verdicts)
    store.publish(WRITER, batch)
    return verdicts


def unmerge_stored(store: NetworkStore, losers: DataFrame, batch: int) -> DataFrame:
    """Undo the merges of ``losers`` (tenant_id, loser_id); returns the report of ``unmerge_people``."""
    seen = store.place(WRITER, batch)
    asked = losers.select("tenant_id", "loser_id").distinct()
    aliases = cut_lineage(store.current("aliases", seen).join(asked.withColumnRenamed("loser_id", "merged_from_id"), ["tenant_id", "merged_from_id"], "left_semi"))
    moved = {name: cut_lineage(store.current(name, seen, aliases, SOURCE_KEY)) for name in ("sources", "interactions", "chunks")}
    people = cut_lineage(store.current("people", seen, asked.withColumnRenamed("loser_id", "id"), ["tenant_id", "id"]))
    after, report = unmerge_people(Network(people, aliases=aliases, **moved), losers)
    freed = aliases.join(after.aliases.select(*SOURCE_KEY), SOURCE_KEY, "left_anti").withColumn("removed", F.lit(True))
    _write(store, Network(after.people, after.sources, freed, after.interactions, after.chunks), batch)
    report = cut_lineage(report)
    store.publish(WRITER, batch)
    return report


def _write(store: NetworkStore, rows: Network, batch: int) -> None:
    for name in ("people", "sources", "aliases", "interactions", "chunks"):
        store.write(name, getattr(rows, name), WRITER, batch)
