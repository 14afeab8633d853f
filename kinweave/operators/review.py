"""Duplicate review: people that share an address or look alike.

A group of n people with one address holds n(n-1)/2 pairs. The pairs are never written out: the
groups themselves say the same in n rows, and the review list, which is the top 25, needs only a
bounded number of members of each group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.text import normalize_email
from kinweave.operators.dedupe import top_per
from kinweave.operators.governance import live_people
from kinweave.operators.matching import distinct_keys, similar_keys, with_match_key
from kinweave.session import cut_lineage

# The review band and the length of the list.
REVIEW_FROM = 0.55
REVIEW_BELOW = 0.999
REVIEW_ROWS = 25
LADDER = [0.95, 0.85, 0.75, REVIEW_FROM]


def shared_email_groups(people: DataFrame) -> DataFrame:
    """(tenant_id, email, person_id, first_id, group_size): live people that share an address.

    All pairs of one address are the pairs of its rows; the group key and size make the relation
    complete without listing them. One aggregation and one join back on the same key.
    """
    mailed = (
        live_people(people)
        .select("tenant_id", normalize_email("primary_email").alias("email"), F.col("id").alias("person_id"))
        .where(F.col("email").isNotNull())
    )
    groups = (
        mailed.groupBy("tenant_id", "email")
        .agg(F.min("person_id").alias("first_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )
    return mailed.join(groups, ["tenant_id", "email"])


def first_shared_email_pairs(people: DataFrame, n: int = REVIEW_ROWS) -> DataFrame:
    """The first ``n`` pairs per tenant in (a_id, b_id) order, out of all pairs with one address.

    The first n pairs of a group lie among its n + 1 smallest ids, so those are enough; the
    row-number filter drops the rest before the shuffle.
    """
    mailed = live_people(people).select("tenant_id", normalize_email("primary_email").alias("email"), "id").where(
        F.col("email").isNotNull()
    )
    heads = top_per(mailed, ["tenant_id", "email"], [F.col("id").asc()], n + 1)
    a, b = heads.withColumnRenamed("id", "a_id"), heads.withColumnRenamed("id", "b_id")
    pairs = a.join(b, ["tenant_id", "email"]).where(F.col("a_id") < F.col("b_id"))
    return top_per(pairs, ["tenant_id"], [F.col("a_id").asc(), F.col("b_id").asc()], n).select(
        "tenant_id", "a_id", "b_id", F.lit(1.0).alias("score"), F.lit("shared email").alias("reason")
    )


def similar_key_pairs(people: DataFrame, threshold: float = REVIEW_FROM, score_fn=None) -> DataFrame:
    """(tenant_id, a_name, a_company, b_name, b_company, score): all unordered pairs of *different*
    normalised (name, company) keys of live people in the review band.

    People with one key are alike for the score, so this table stands for every pair of people.
    People are taken in (name, company) order, which decides the first argument of the score.
    """
    keys = distinct_keys(with_match_key(live_people(people)))
    score = similar_keys(keys, keys, threshold, score_fn).where(F.col("score") < REVIEW_BELOW)
    named = keys.drop("tenant_id")

    def side(p: str, key: str) -> DataFrame:
        return named.select(
            F.col("match_key").alias(key), F.col("name_key").alias(f"{p}_name"), F.col("company_key").alias(f"{p}_company")
        )

    joined = score.join(side("a", "left_key"), "left_key").join(side("b", "right_key"), "right_key")
    ahead = F.struct("a_name", "a_company") < F.struct("b_name", "b_company")
    return joined.where(ahead).select(
        "tenant_id", "left_key", "right_key", "a_name", "a_company", "b_name", "b_company", "score"
    )


def _first_fuzzy_pairs(people: DataFrame, threshold: float, n: int, score_fn=None) -> DataFrame:
    """The first ``n`` look-alike pairs per tenant by score, then key, then id; pairs that share an
    address are not among them.

    Every pair of keys gives at least one pair of people unless all of both sides share one
    address, so the n best other key pairs are enough. Within a key, the n + 1 addresses with the
    smallest ids and the n smallest ids of each hold the first n pairs.
    """
    live = with_match_key(live_people(people).where((F.col("company") != "") & (F.col("display_name") != "")))
    live = live.where(F.col("match_key").isNotNull()).select(
        "tenant_id", "match_key", "id", normalize_email("primary_email").alias("email")
    )
    # One shared address for the whole key, or NULL.
    only = live.groupBy("match_key").agg(
        F.when(
            (F.count("email") == F.count("*")) & (F.min("email") == F.max("email")), F.min("email")
        ).alias("only_email")
    )
    pairs = similar_key_pairs(people, threshold, score_fn)
    usable = (
        pairs.join(only.select(F.col("match_key").alias("left_key"), F.col("only_email").alias("_le")), "left_key")
        .join(only.select(F.col("match_key").alias("right_key"), F.col("only_email").alias("_re")), "right_key")
        .where(~F.coalesce(F.col("_le") == F.col("_re"), F.lit(False)))
    )
    order = [F.col(c).asc() for c in ("a_name", "a_company", "b_name", "b_company")]
    head = cut_lineage(top_per(usable, ["tenant_id"], [F.col("score").desc(), *order], n))

    needed = head.select(F.col("left_key").alias("match_key")).unionByName(
        head.select(F.col("right_key").alias("match_key"))
    ).distinct()
    mail_unit = F.coalesce("email", F.concat(F.lit("\u0001"), F.col("id").cast("string")))
    members = live.join(needed, "match_key").withColumn("unit", mail_unit)
    units = members.groupBy("match_key", "unit").agg(F.min("id").alias("_first"))
    units = top_per(units, ["match_key"], [F.col("_first").asc()], n + 1).drop("_first")
    heads = top_per(members.join(units, ["match_key", "unit"]), ["match_key", "unit"], [F.col("id").asc()], n)

    def side(p: str, key: str) -> DataFrame:
        return heads.select(F.col("match_key").alias(key), F.col("id").alias(f"{p}_id"), F.col("email").alias(f"_{p}_email"))

    people_pairs = (
        head.join(side("a", "left_key"), "left_key")
        .join(side("b", "right_key"), "right_key")
        .where(~F.coalesce(F.col("_a_email") == F.col("_b_email"), F.lit(False)))
    )
    return top_per(
        people_pairs,
        ["tenant_id"],
        [F.col("score").desc(), *order, F.col("a_id").asc(), F.col("b_id").asc()],
        n,
        rank="_place",
    ).select("tenant_id", "a_id", "b_id", "score", F.lit("fuzzy name + company").alias("reason"), "_place")


def review_queue(people: DataFrame, sources: DataFrame, n: int = REVIEW_ROWS, score_fn=None) -> DataFrame:
    """The ``n`` best merge candidates of every tenant, with the side to keep.

    Shared addresses score 1.0 and come first. Look-alikes are searched from a high threshold
    downwards: once a rung leaves no tenant short, lower scores cannot enter the list.
    """
    mailed = cut_lineage(first_shared_email_pairs(people, n))
    have = mailed.groupBy("tenant_id").agg(F.count("*").alias("_have"))
    tenants = live_people(people).select("tenant_id").distinct().join(have, "tenant_id", "left")
    short = cut_lineage(tenants.where(F.coalesce("_have", F.lit(0)) < n))
    fuzzy = None
    if not short.isEmpty():
        wanting = people.join(short.select("tenant_id"), "tenant_id", "left_semi")
        for threshold in LADDER:
            fuzzy = cut_lineage(_first_fuzzy_pairs(wanting, threshold, n, score_fn))
            found = fuzzy.groupBy("tenant_id").agg(F.count("*").alias("_found"))
            lacking = short.join(found, "tenant_id", "left").where(
                F.coalesce("_have", F.lit(0)) + F.coalesce("_found", F.lit(0)) < n
            )
            if lacking.isEmpty():
                break
    listed = mailed.withColumn(
        "_place", F.row_number().over(Window.partitionBy("tenant_id").orderBy("a_id", "b_id"))
    )
    if fuzzy is not None:
        listed = listed.unionByName(fuzzy)
    queue = top_per(
        listed, ["tenant_id"], [F.col("reason").desc(), F.col("_place").asc()], n, rank="place"
    ).drop("_place")
    return pick_winners(queue, people, sources)


def pick_winners(pairs: DataFrame, people: DataFrame, sources: DataFrame) -> DataFrame:
    """Add the winner (more source rows, a tie keeps a), both sides' names and source lists."""
    wanted = pairs.select(F.col("a_id").alias("person_id")).unionByName(
        pairs.select(F.col("b_id").alias("person_id"))
    ).distinct()
    provenance = (
        sources.join(wanted, "person_id", "left_semi")
        .groupBy("person_id")
        .agg(F.count("*").alias("n_sources"), source_list().alias("sources"))
    )
    facts = people.join(wanted.withColumnRenamed("person_id", "id"), "id", "left_semi").select(
        F.col("id").alias("person_id"), "display_name", "company", "primary_email"
    ).join(provenance, "person_id", "left")

    def side(p: str) -> DataFrame:
        return facts.select(
            F.col("person_id").alias(f"{p}_id"),
            F.col("display_name").alias(f"{p}_name"),
            F.col("company").alias(f"{p}_company"),
            F.col("primary_email").alias(f"{p}_email"),
            F.coalesce("sources", F.lit("")).alias(f"{p}_sources"),
            F.coalesce("n_sources", F.lit(0)).alias(f"{p}_count"),
        )

    keeps_a = F.col("a_count") >= F.col("b_count")
    return (
        pairs.join(side("a"), "a_id")
        .join(side("b"), "b_id")
        .withColumn("winner_id", F.when(keeps_a, F.col("a_id")).otherwise(F.col("b_id")))
        .withColumn("loser_id", F.when(keeps_a, F.col("b_id")).otherwise(F.col("a_id")))
        .withColumn("score", F.round("score", 2))
        .select(
            "tenant_id", "place", "score", "reason", "winner_id", "loser_id",
            "a_id", "a_name", "a_company", "a_email", "a_sources",
            "b_id", "b_name", "b_company", "b_email", "b_sources",
        )
    )


def source_list() -> Column:
    """Sorted distinct source types as text. Source types are a closed set of a few values."""
    return F.array_join(F.sort_array(F.collect_set("source_type")), ",")
