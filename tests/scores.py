"""Scores of normalised (name, company) keys, for comparisons with brute force."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from kinweave.functions import text


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio() if a or b else 0.0


def key_score(a: tuple[str, str], b: tuple[str, str]) -> float:
    """Six parts name, four parts company; nothing without both companies."""
    return 0.6 * ratio(a[0], b[0]) + 0.4 * ratio(a[1], b[1]) if a[1] and b[1] else 0.0


def keys(spark, rows: list[dict]) -> dict[tuple, tuple[str, str]]:
    """(display_name, company) as written -> its normalised key."""
    pairs = sorted({(r["display_name"], r["company"]) for r in rows}, key=str)
    df = spark.createDataFrame(pairs, "n STRING, c STRING")
    told = df.select("n", "c", F.coalesce(text.normalize_name("n"), F.lit("")), F.coalesce(text.normalize_company("c"), F.lit(""))).collect()
    return {(r[0], r[1]): (r[2], r[3]) for r in told}
