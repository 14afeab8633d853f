"""Connection-list CSV exports with a preamble of varying length."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.text import blank_to_null, headline, stable_id, strip
from kinweave.schemas import to_record
from kinweave.session import spread_if_small

SOURCE_TYPE = "linkedin"
# The first header cell, and the columns that are read.
HEADER_START = "first name"
COLUMNS = ["first name", "last name", "company", "position", "email address", "url"]


def decode(content: Column | str) -> Column:
    """Bytes to text: UTF-8 without its mark, else Latin-1."""
    raw = F.col(content) if isinstance(content, str) else content
    utf8 = F.regexp_replace(F.try_validate_utf8(raw.cast("string")), "^﻿", "")
    return F.coalesce(utf8, F.decode(raw, "ISO-8859-1"))


def read_exports(spark: SparkSession, path: str, tenant_id: str) -> DataFrame:
    """(tenant_id, file, content): one row per export file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.lit(tenant_id).alias("tenant_id"), F.col("path").alias("file"), decode("content").alias("content")
    )


def _rows(content: str) -> Iterator[dict]:
    reader = csv.reader(io.StringIO(content))
    for row in reader:
        if row and row[0].strip().lower() == HEADER_START:
            header = [cell.strip().lower() for cell in row]
            break
    else:
        return
    places = {name: header.index(name) for name in COLUMNS if name in header}
    for line, row in enumerate(reader):
        if any(cell.strip() for cell in row):
            yield {
                "line": line,
                **{n: (row[places[n]] if n in places and places[n] < len(row) else None) for n in COLUMNS},
            }


def export_rows(exports: DataFrame) -> DataFrame:
    """Cells of every row below the header. Quoted cells may span lines, so a file is read as a whole;
    its rows leave in batches, those of many small files together, and everything after the split is column
    expressions."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[dict] = []
        for pdf in batches:
            for tenant, file, content in zip(pdf["tenant_id"], pdf["file"], pdf["content"]):
                for row in _rows(content or ""):
                    rows.append({"tenant_id": tenant, "file": file, **row})
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows)
                        rows = []
        if rows:
            yield pd.DataFrame(rows)

    cells = ", ".join(f"`{n}` STRING" for n in COLUMNS)
    kind = exports.schema["tenant_id"].dataType.simpleString()
    return spread_if_small(exports.select("tenant_id", "file", "content")).mapInPandas(
        task, f"tenant_id {kind}, file STRING, line BIGINT, {cells}"
    )


def connection_records(exports: DataFrame) -> DataFrame:
    def cell(name: str) -> Column:
        return blank_to_null(strip(F.col(f"`{name}`")))

    full_name = strip(
        F.concat(F.coalesce(cell("first name"), F.lit("")), F.lit(" "), F.coalesce(cell("last name"), F.lit("")))
    )
    flat = export_rows(exports).select(
        "tenant_id",
        F.lit(SOURCE_TYPE).alias("source_type"),
        stable_id(cell("url"), full_name, cell("company")).alias("source_record_id"),
        blank_to_null(full_name).alias("display_name"),
        cell("email address").alias("primary_email"),
        cell("company").alias("company"),
        cell("position").alias("title"),
        F.to_json(
            F.struct(
                F.coalesce(cell("first name"), F.lit("")).alias("first"),
                F.coalesce(cell("last name"), F.lit("")).alias("last"),
                cell("company").alias("company"),
                cell("position").alias("position"),
            )
        ).alias("raw"),
    )
    anchored = flat.where(F.col("display_name").isNotNull() | F.col("primary_email").isNotNull())
    return to_record(anchored.withColumn("text", headline("display_name", "title", "company", "primary_email")))
