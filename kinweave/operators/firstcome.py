"""First-come-first-served decisions as set operations.

Sequential rules such as "a record makes a new person unless an earlier one made a matching
person" or "a merge is refused once an earlier merge took its loser" have one shape: every item
has a position, claims keys when it is accepted, and is refused when an *earlier accepted* item
claimed a key it checks. The result is the greedy selection in position order. It is found in
rounds: an item is refused as soon as an earlier claimer is in, and accepted as soon as no
earlier claimer is open. A round is a few aggregations and joins over all open items at once;
the number of rounds is the longest chain of dependent decisions, not the number of items.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.session import cut_lineage, scratch_path


@dataclass
class Relation:
    """Items check the key in column ``check`` against claims in column ``claim``.

    ``edges`` (check_key, claim_key) widens equality to a given relation of keys.
    """

    check: str
    claim: str
    edges: DataFrame | None = None


def first_come(items: DataFrame, relations: list[Relation], pos: str = "pos") -> DataFrame:
    """``items`` with a boolean ``accepted``. NULL keys neither claim nor conflict.

    A round reads and writes the items that were still open only: an earlier acceptance has refused all it
    can refuse in the round after it. The earliest open item is always decided, so rounds end.
    """
    spark, names = items.sparkSession, items.columns
    base, turn = scratch_path(spark, "decisions"), 0
    start = items.withColumn("accepted", F.lit(None).cast("boolean"))
    start.write.parquet(f"{base}/{turn}")
    while True:
        state = spark.read.schema(start.schema).parquet(f"{base}/{turn}")
        waiting = state.where(F.col("accepted").isNull())
        if waiting.isEmpty():
            break
        refused, blocked = F.lit(False), F.lit(False)
        for i, relation in enumerate(relations):
            held = (
                state.where(F.col(relation.claim).isNotNull() & F.coalesce(F.col("accepted"), F.lit(True)))
                .groupBy(F.col(relation.claim).alias(f"_key{i}"))
                .agg(
                    F.min(F.when(F.col("accepted"), F.col(pos))).alias(f"_in{i}"),
                    F.min(F.when(F.col("accepted").isNull(), F.col(pos))).alias(f"_open{i}"),
                )
            )
            if relation.edges is not None:
                held = (
                    relation.edges.join(held, F.col("claim_key") == F.col(f"_key{i}"))
                    .groupBy(F.col("check_key").alias(f"_key{i}"))
                    .agg(F.min(f"_in{i}").alias(f"_in{i}"), F.min(f"_open{i}").alias(f"_open{i}"))
                )
            waiting = waiting.join(held, F.col(relation.check) == F.col(f"_key{i}"), "left")
            refused = refused | F.coalesce(F.col(f"_in{i}") < F.col(pos), F.lit(False))
            blocked = blocked | F.coalesce(F.col(f"_open{i}") < F.col(pos), F.lit(False))
        turn += 1
        decision = F.when(refused, False).when(~blocked, True).alias("accepted")
        waiting.select(*names, decision).write.parquet(f"{base}/{turn}")
    every = spark.read.schema(start.schema).option("recursiveFileLookup", "true").parquet(base)
    return every.where(F.col("accepted").isNotNull())


def last_links(links: DataFrame, child: str, parent: str, max_rounds: int = 64) -> DataFrame:
    """Follow child -> parent links to their end, doubling the step each round.

    Returns (child, root, last): the end of the chain and the node before it.
    """
    reach = links.select(
        F.col(child).alias("_c"), F.col(parent).alias("_root"), F.col(child).alias("_last")
    )
    reach = cut_lineage(reach)
    for _ in range(max_rounds):
        step = reach.select(
            F.col("_c").alias("_via"), F.col("_root").alias("_root2"), F.col("_last").alias("_last2")
        )
        joined = reach.join(step, F.col("_root") == F.col("_via"), "left")
        reach = cut_lineage(
            joined.select(
                "_c",
                F.coalesce("_root2", "_root").alias("_root"),
                F.coalesce("_last2", "_last").alias("_last"),
                F.col("_via").isNotNull().alias("_moved"),
            )
        )
        if reach.where("_moved").isEmpty():
            return reach.select(F.col("_c").alias(child), F.col("_root").alias("root"), F.col("_last").alias("last"))
        reach = reach.drop("_moved")
    raise RuntimeError("merge links form a cycle")
