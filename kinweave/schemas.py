"""Fixed schemas of the sources and of the stored tables (DDL strings)."""

from __future__ import annotations

CONTACTS = (
    "tenant_id STRING, resourceName STRING, "
    "names ARRAY<STRUCT<displayName: STRING>>, "
    "emailAddresses ARRAY<STRUCT<value: STRING, metadata: STRUCT<primary: BOOLEAN>>>, "
    "organizations ARRAY<STRUCT<name: STRING, title: STRING>>"
)

MESSAGES = (
    "tenant_id STRING, id STRING, internalDate STRING, "
    "payload STRUCT<headers: ARRAY<STRUCT<name: STRING, value: STRING>>>"
)

CHANGES = "tenant_id STRING, op STRING, message_id STRING, history_id STRING, pos BIGINT"

CALENDAR = (
    "tenant_id STRING, id STRING, status STRING, summary STRING, "
    "start STRUCT<dateTime: STRING, date: STRING>, "
    "attendees ARRAY<STRUCT<email: STRING, displayName: STRING, self: BOOLEAN, resource: BOOLEAN>>"
)

RECORD_COLUMNS = [
    "tenant_id",
    "source_type",
    "source_record_id",
    "display_name",
    "primary_email",
    "company",
    "title",
    "text",
    "raw",
]
RECORD = ", ".join(f"{name} STRING" for name in RECORD_COLUMNS)

PEOPLE = (
    "id STRING, tenant_id STRING, display_name STRING, primary_email STRING, company STRING, "
    "title STRING, merged_into_id STRING"
)
PERSON_SOURCES = (
    "tenant_id STRING, source_type STRING, source_record_id STRING, person_id STRING, "
    "raw STRING, matched_confidence DOUBLE"
)
PERSON_ALIASES = (
    "tenant_id STRING, source_type STRING, source_record_id STRING, person_id STRING, "
    "decided_by STRING, merged_from_id STRING"
)
INTERACTIONS = (
    "tenant_id STRING, source_type STRING, source_record_id STRING, external_id STRING, "
    "person_id STRING, interaction_type STRING, occurred_at TIMESTAMP, subject STRING, "
    "deleted_at TIMESTAMP"
)
CHUNKS = (
    "tenant_id STRING, source_type STRING, source_record_id STRING, external_id STRING, "
    "content_hash STRING, person_id STRING, chunk_text STRING, embedding ARRAY<FLOAT>"
)
SYNC_STATE = "tenant_id STRING, source_type STRING, cursor STRING, last_synced_at TIMESTAMP"
SYNC_ERRORS = "tenant_id STRING, source_type STRING, source_record_id STRING, stage STRING, reason STRING"

SOURCE_KEY = ["tenant_id", "source_type", "source_record_id"]
CHUNK_KEY = ["tenant_id", "source_record_id", "content_hash"]


def to_record(df):
    """Project to the record contract; columns a source does not have become NULL."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(
        *[(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in RECORD_COLUMNS]
    )
