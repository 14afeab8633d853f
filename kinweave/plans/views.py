"""The contact-network tables as views over the driver's tables. Whole tables, no samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.merging import Network


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").cast("bigint").alias("tenant_id"))


def customer_email():
    return F.concat(F.lower("c_name"), F.lit("@nation"), F.col("c_nationkey").cast("string"), F.lit(".example"))


def people(spark: SparkSession, d: str) -> DataFrame:
    """Customers as people; the tenant is the region. A negative balance marks a person merged into
    the one with half the key."""
    into = F.when((F.col("c_acctbal") < 0) & (F.col("c_custkey") > 0), F.floor(F.col("c_custkey") / 2).cast("bigint"))
    return (
        table(spark, d, "customer")
        .join(_nations(spark, d), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("id"),
            "tenant_id",
            F.col("c_name").alias("display_name"),
            customer_email().alias("primary_email"),
            F.col("c_mktsegment").alias("company"),
            F.col("n_name").alias("title"),
            into.alias("merged_into_id"),
        )
    )


def _with_tenant(spark: SparkSession, d: str, df: DataFrame) -> DataFrame:
    owner = people(spark, d).select(F.col("id").alias("person_id"), "tenant_id")
    return df.join(owner, "person_id")


def event_source():
    return (
        F.when(F.col("event_type") == "click", "gmail")
        .when(F.col("event_type") == "view", "calendar")
        .when(F.col("event_type") == "purchase", "contacts")
        .otherwise("linkedin")
    )


def interactions(spark: SparkSession, d: str) -> DataFrame:
    """Events as timeline rows; errors are soft-deleted ones."""
    rows = table(spark, d, "events").select(
        event_source().alias("source_type"),
        F.concat_ws("#", F.col("event_id").cast("string"), F.col("user_id").cast("string")).alias("source_record_id"),
        F.col("event_id").cast("string").alias("external_id"),
        F.col("user_id").alias("person_id"),
        F.col("event_type").alias("interaction_type"),
        F.col("ts").alias("occurred_at"),
        F.concat(F.lit("k="), F.get_json_object("props", "$.k")).alias("subject"),
        F.when(F.col("event_type") == "error", F.col("ts")).alias("deleted_at"),
    )
    return _with_tenant(spark, d, rows)


def sources(spark: SparkSession, d: str) -> DataFrame:
    """Provenance rows: one per event and one per order."""
    from_events = table(spark, d, "events").select(
        event_source().alias("source_type"),
        F.concat_ws("#", F.col("event_id").cast("string"), F.col("user_id").cast("string")).alias("source_record_id"),
        F.col("user_id").alias("person_id"),
        F.col("props").alias("raw"),
        F.lit(None).cast("double").alias("matched_confidence"),
    )
    from_orders = table(spark, d, "orders").select(
        F.lit("contacts").alias("source_type"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("source_record_id"),
        F.col("o_custkey").alias("person_id"),
        F.to_json(F.struct("o_orderstatus")).alias("raw"),
        F.round(F.col("o_totalprice") / 1e6, 4).alias("matched_confidence"),
    )
    return _with_tenant(spark, d, from_events.unionByName(from_orders))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as text chunks, dealt out to the people in turn."""
    people_count = table(spark, d, "customer").count()
    rows = table(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.col("doc_id").cast("string").alias("source_record_id"),
        F.col("doc_id").cast("string").alias("external_id"),
        F.when(F.col("lang") == "en", "gmail").otherwise("contacts").alias("source_type"),
        F.sha2("text", 256).alias("content_hash"),
        F.pmod("doc_id", F.lit(people_count)).alias("person_id"),
        F.col("text").alias("chunk_text"),
    )
    return _with_tenant(spark, d, rows)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as chunks with vectors, dealt out to the people in turn."""
    people_count = table(spark, d, "customer").count()
    rows = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.pmod("vec_id", F.lit(people_count)).alias("person_id"),
        "embedding", F.col("label").cast("bigint").alias("label"),
    )
    return _with_tenant(spark, d, rows)


def asked(spark: SparkSession, d: str) -> DataFrame:
    """User turns as questions, dealt out to the people in turn: every turn's own text (wording 3), and for
    three conversations in four one more question that names the asker's company (0), name (1) or both cues (2)."""
    people_count = table(spark, d, "customer").count()
    turns = table(spark, d, "conversations").where(F.col("role") == "user").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"),
        F.pmod("conv_id", F.lit(people_count)).alias("asker"),
        F.pmod("conv_id", F.lit(4)).alias("wording"),
        F.col("text").alias("turn_text"),
    )
    who = people(spark, d).select(F.col("id").alias("asker"), "tenant_id", "display_name", "company")
    text = (
        F.when(F.col("wording") == 0, F.concat(F.lit("Who do I know at "), F.lower("company"), F.lit("?")))
        .when(F.col("wording") == 1, F.concat(F.lit("When did I last talk to "), F.col("display_name"), F.lit("?")))
        .when(F.col("wording") == 2, F.concat(F.lit("when did I last meet anyone at "), F.col("company")))
    )
    own = F.struct(F.concat("qid", F.lit("-own")).alias("qid"), F.lit(3).cast("bigint").alias("wording"), F.col("turn_text").alias("question"))
    worded = F.struct("qid", F.col("wording").cast("bigint").alias("wording"), text.alias("question"))
    both = F.filter(F.array(own, worded), lambda q: q["question"].isNotNull())
    return turns.join(who, "asker").select("tenant_id", "asker", F.inline(both))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d).select("qid", "tenant_id", "question")


def aliases(spark: SparkSession, d: str) -> DataFrame:
    """Urgent orders are decided by hand: their record belongs to the customer with half the key."""
    rows = table(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(
        F.lit("contacts").alias("source_type"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("source_record_id"),
        F.floor(F.col("o_custkey") / 2).cast("bigint").alias("person_id"),
        F.col("o_custkey").alias("_owner"),
    )
    owner = people(spark, d).select(F.col("id").alias("_owner"), "tenant_id")
    return rows.join(owner, "_owner").select(
        "tenant_id", "source_type", "source_record_id", "person_id", F.lit("manual").alias("decided_by"),
        F.lit(None).cast("bigint").alias("merged_from_id"),
    )


def network(spark: SparkSession, d: str) -> Network:
    return Network(people(spark, d), sources(spark, d), aliases(spark, d), interactions(spark, d), chunks(spark, d))
