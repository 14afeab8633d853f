"""Tenant isolation and the two visibility filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tenant_view(df: DataFrame, tenant) -> DataFrame:
    """Rows of one tenant. No tenant is an error, never an open or empty read."""
    if tenant is None or tenant == "":
        raise PermissionError("no tenant is set for this read")
    return df.where(F.col("tenant_id") == F.lit(tenant))


def check_tenant_write(df: DataFrame, tenant) -> DataFrame:
    """The rows unchanged; the job that writes them fails on a row of any other tenant."""
    if tenant is None or tenant == "":
        raise PermissionError("no tenant is set for this write")
    own = F.coalesce(F.col("tenant_id") == F.lit(tenant), F.lit(False))
    refused = F.raise_error(F.lit("row belongs to another tenant")).cast(df.schema["tenant_id"].dataType)
    return df.withColumn("tenant_id", F.when(own, F.col("tenant_id")).otherwise(refused))


def live_people(people: DataFrame) -> DataFrame:
    return people.where(F.col("merged_into_id").isNull())


def live_interactions(interactions: DataFrame) -> DataFrame:
    return interactions.where(F.col("deleted_at").isNull())
