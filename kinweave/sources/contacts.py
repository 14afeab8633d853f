"""Address-book export: nested rows to records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.text import headline, primary_email
from kinweave.schemas import CONTACTS, to_record

SOURCE_TYPE = "contacts"


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """A full pull: every landed page, no cursor."""
    return spark.read.schema(CONTACTS).json(path)


def contact_records(contacts: DataFrame) -> DataFrame:
    name = F.get("names", F.lit(0))["displayName"]
    organisation = F.get("organizations", F.lit(0))
    flat = contacts.select(
        "tenant_id",
        F.lit(SOURCE_TYPE).alias("source_type"),
        F.coalesce("resourceName", F.lit("")).alias("source_record_id"),
        name.alias("display_name"),
        primary_email("emailAddresses").alias("primary_email"),
        organisation["name"].alias("company"),
        organisation["title"].alias("title"),
        F.to_json(F.struct("names", "emailAddresses", "organizations")).alias("raw"),
    )
    anchored = flat.where(
        F.coalesce(F.col("display_name") != "", F.lit(False)) | F.coalesce(F.col("primary_email") != "", F.lit(False))
    )
    return to_record(anchored.withColumn("text", headline("display_name", "title", "company", "primary_email")))
