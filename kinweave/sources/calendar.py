"""Calendar events: one event to one row per external attendee, cancellations apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.text import blank_to_null, event_start, participant_key, strip, touch_text
from kinweave.schemas import CALENDAR

SOURCE_TYPE = "calendar"
# Fixed value: where a full read starts.
FULL_READ_FROM = "2000-01-01"


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CALENDAR).json(path)


def full_window(events: DataFrame) -> DataFrame:
    """A full read takes events from the first supported day on."""
    return events.where(event_start("start") >= F.lit(FULL_READ_FROM).cast("timestamp"))


def split_cancelled(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events to store, (tenant_id, source_type, external_id) to delete)."""
    off = F.coalesce(F.col("status") == "cancelled", F.lit(False))
    gone = events.where(off).select(
        "tenant_id", F.lit(SOURCE_TYPE).alias("source_type"), F.coalesce("id", F.lit("")).alias("external_id")
    )
    return events.where(~off), gone


def event_participants(events: DataFrame) -> DataFrame:
    """One row per attendee who is neither the owner nor a room and has an address.

    Own entries and repeats are settled inside the row; the fan-out needs no shuffle.
    """

    def wanted(a):
        address = strip(F.coalesce(a["email"], F.lit("")))
        return (
            ~F.coalesce(a["self"], F.lit(False))
            & ~F.coalesce(a["resource"], F.lit(False))
            & F.contains(address, F.lit("@"))
        )

    listed = events.select(
        "tenant_id",
        F.coalesce("id", F.lit("")).alias("external_id"),
        F.coalesce(blank_to_null("summary"), F.lit("(no title)")).alias("subject"),
        event_start("start").alias("occurred_at"),
        F.transform(
            F.filter("attendees", wanted),
            lambda a: F.struct(strip(a["email"]).alias("email"), a["displayName"].alias("name")),
        ).alias("people"),
    )
    keys = F.transform("people", lambda a: F.lower(a["email"]))
    firsts = F.filter("people", lambda a, i: F.array_position(F.col("keys"), F.lower(a["email"])) == i + 1)
    rows = listed.withColumn("keys", keys).withColumn("people", firsts).select(
        "*", F.posexplode("people").alias("pos", "a")
    )
    return rows.select(
        "tenant_id",
        F.lit(SOURCE_TYPE).alias("source_type"),
        participant_key("external_id", F.lower("a.email")).alias("source_record_id"),
        F.col("a.name").alias("display_name"),
        F.col("a.email").alias("primary_email"),
        F.lit(None).cast("string").alias("company"),
        F.lit(None).cast("string").alias("title"),
        touch_text("Meeting", "subject", "a.name", "a.email").alias("text"),
        F.to_json(F.struct(F.col("external_id").alias("event_id"), F.col("subject").alias("title"))).alias("raw"),
        "external_id",
        F.lit("meeting").alias("interaction_type"),
        "occurred_at",
        "subject",
        "pos",
    )
