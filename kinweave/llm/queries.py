"""One query for each corpus operator, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import (
    decontaminate,
    filter_audit,
    itq,
    language,
    minhash,
    mixture,
    order_minhash,
    pii,
    pitman_yor,
    shard_table,
    templates,
    term_pipeline,
)
from kinweave.llm.common import table
from kinweave.llm.oracle import ORACLE
from kinweave.session import adopt, scratch_path

__all__ = ["ORACLE", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

TOKENIZER = "word_bpe_49k.json"
END_ID = 1


def query(function):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(adopt(spark), sf_dir)

    QUERIES[function.__name__] = run
    return function


@query
def op1_language_id(spark, d):
    return language.predict(table(spark, d, "documents"))


@query
def op2_token_files(spark, d):
    from pathlib import Path

    import public_tokenizers

    from kinweave.llm.token_files import read_tokens, write_tokens

    vocabulary = Path(public_tokenizers.path(TOKENIZER)).read_text(encoding="utf-8")
    return read_tokens(write_tokens(table(spark, d, "documents"), scratch_path(spark, "tokens"), vocabulary, END_ID))


@query
def op3_page_text(spark, d):
    return templates.extract(table(spark, d, "pages"))


@query
def op4_pitman_yor(spark, d):
    return pitman_yor.report(table(spark, d, "documents"))


@query
def op5_pii(spark, d):
    return pii.report(table(spark, d, "documents"))


@query
def op6_minhash(spark, d):
    return minhash.near_copies(table(spark, d, "documents"), words=2)


@query
def op7_decontaminate(spark, d):
    return decontaminate.report(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def op8_itq(spark, d):
    return itq.near_copies(table(spark, d, "embeddings"))


@query
def op9_mixture(spark, d):
    return mixture.report(table(spark, d, "documents"))


@query
def op10_shard_table(spark, d):
    return shard_table.report(table(spark, d, "documents"))


@query
def op11_order_minhash(spark, d):
    return order_minhash.report(table(spark, d, "documents"))


@query
def op12_term_pipeline(spark, d):
    return term_pipeline.search(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def op13_filter_audit(spark, d):
    return filter_audit.report(spark, f"{d}/documents.parquet", table(spark, d, "labels"))
