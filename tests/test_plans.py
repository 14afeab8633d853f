"""The shape of the physical plans and the driver contract."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from kinweave.operators import dedupe, keyed, ranking
from kinweave.plans import retrieval, views

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver data is absent")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("pos"))
    for out in (dedupe.first_per(df, ["k"], "pos"), dedupe.latest_per(df, ["k"], "pos"), dedupe.top_per(df, ["k"], [F.col("pos")], 20)):
        text = plan(out)
        assert text.count("WindowGroupLimit") == 2  # once per map task, once after the shuffle
        assert text.index("Exchange") < text.rindex("WindowGroupLimit")


@needs_data
def test_scans_read_the_columns_they_need(spark):
    text = plan(retrieval.recency_citations(views.interactions(spark, DATA), views.people(spark, DATA)))
    assert "l_" not in text and "o_totalprice" not in text
    page = plan(ranking.people_page(views.people(spark, DATA).where("id < 50").select("id", "display_name", "merged_into_id")))
    assert "LessThan(c_custkey,50)" in page and "TakeOrderedAndProject" in page
    assert "c_mktsegment" not in page


@needs_data
def test_no_query_compares_everything_with_everything(spark):
    queries = contract.queries()
    for name in ("recency_topk", "recent_per_person", "upsert_latest", "apply_deletions", "shared_email_pairs", "alias_then_email", "person_provenance"):
        text = plan(queries[name](spark, DATA))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


@needs_data
def test_upserts_keep_the_old_table_unshuffled_when_the_change_is_small(spark):
    old = spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey", "o_custkey")
    new = spark.createDataFrame([(1, 2, 0)], "o_orderkey BIGINT, o_custkey BIGINT, pos INT")
    out = keyed.upsert(old, new, ["o_orderkey"], "pos")
    out.collect()
    assert "BroadcastHashJoin" in plan(out) and out.where("o_custkey = 2 and o_orderkey = 1").count() == 1


@needs_data
def test_entry_and_contract(spark):
    assert len(contract.entry(spark).take(1)) == 1
    assert set(contract.oracle_sql()) <= set(contract.queries())


@needs_data
@pytest.mark.parametrize("name", ["recency_topk", "message_fanout", "contact_records", "hybrid_union", "merge_aliases", "semantic_topk_batch"])
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM read_parquet('{DATA}/{file}')")
    result = con.execute(contract.oracle_sql()[name])
    columns = sorted(c[0] for c in result.description)
    places = [[c[0] for c in result.description].index(c) for c in columns]
    expected = sorted(tuple(str(r[i]) for i in places) for r in result.fetchall())
    out = contract.queries()[name](spark, DATA)
    assert sorted(out.columns) == columns
    assert sorted(tuple(str(r[c]) for c in columns) for r in out.collect()) == expected


@needs_data
def test_listing_and_scores_are_not_cut(spark):
    queries = contract.queries()
    assert queries["bulk_load"](spark, DATA).count() == spark.read.parquet(f"{DATA}/orders.parquet").count() > 500
    pairs = [r.score for r in queries["fuzzy_review_pairs"](spark, DATA).select("score").collect()]
    assert 0.55 <= min(pairs) < 0.6 and max(pairs) >= 0.85
    weak = [r.confidence for r in queries["weak_scores"](spark, DATA).select("confidence").collect()]
    assert min(c for c in weak if c is not None) < 0.8
