"""Retrieval evaluation as aggregations over hits and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.text import normalize_email


def intent_accuracy(routed: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: labelled questions and the share of them routed as labelled."""
    right = F.when(F.col("intent") == F.col("label"), 1.0).otherwise(0.0)
    return routed.join(labels, "qid").agg(F.count("*").alias("questions"), F.avg(right).alias("accuracy"))


def recall_per_question(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """(qid, relevant, found, recall). ``relevant`` has one (qid, person_id) row per expected person;
    questions without such a row are not scored."""
    got = hits.select("qid", "person_id").distinct().withColumn("_hit", F.lit(1))
    return (
        relevant.select("qid", "person_id").distinct()
        .join(got, ["qid", "person_id"], "left")
        .groupBy("qid")
        .agg(F.count("*").alias("relevant"), F.count("_hit").alias("found"))
        .withColumn("recall", F.col("found") / F.col("relevant"))
    )


def recall_in_groups(hits: DataFrame, asked: DataFrame, members: DataFrame, group: list[str]) -> DataFrame:
    """``recall_per_question`` where the expected people of a question are whole groups: ``asked`` is
    (qid, group..), ``members`` (group.., person_id), a person in one group only. Groups are counted and
    only hits are looked up in them, so questions and people are not multiplied."""
    people = members.select(*group, "person_id").distinct()
    wanted = asked.select("qid", *group).distinct()
    sizes = people.groupBy(*group).agg(F.count("*").alias("_size"))
    relevant = wanted.join(sizes, group).groupBy("qid").agg(F.sum("_size").alias("relevant"))
    got = hits.select("qid", "person_id").distinct().join(people, "person_id").join(wanted, ["qid", *group])
    return (
        relevant.join(got.groupBy("qid").agg(F.count("*").alias("_found")), "qid", "left")
        .select("qid", "relevant", F.coalesce("_found", F.lit(0).cast("bigint")).alias("found"))
        .withColumn("recall", F.col("found") / F.col("relevant"))
    )


def mean_recall(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    return mean_of(recall_per_question(hits, relevant))


def mean_of(recalls: DataFrame) -> DataFrame:
    return recalls.agg(F.count("*").alias("questions"), F.avg("recall").alias("mean_recall"))


def answered_zero_questions(hits: DataFrame, zero_questions: DataFrame) -> DataFrame:
    """Hits of questions that must match nobody; empty when all is well."""
    return hits.join(zero_questions.select("qid").distinct(), "qid", "left_semi")


def ungrounded(citations: DataFrame, people: DataFrame) -> DataFrame:
    """Citations whose address is no known person's; citations without an address are not judged."""
    known = people.select("tenant_id", normalize_email("primary_email").alias("_email")).where("_email is not null")
    cited = citations.where(F.col("email").isNotNull()).withColumn("_email", normalize_email("email"))
    return cited.join(known, ["tenant_id", "_email"], "left_anti").drop("_email")
