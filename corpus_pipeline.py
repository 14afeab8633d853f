"""The documents table made into training shards, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``; all but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import decontaminate, language, minhash, mixture, shard_table
from kinweave.llm.common import fresh, table
from kinweave.session import adopt, cut_lineage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or with a narrow margin between languages, go."""
    adopt(spark)
    out, (_, _, rejected) = language.identify(docs, language.fit(docs))
    return out.where(~F.col(rejected)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, 0.8) one row stays: of the smallest id, null last,
    and of that id's texts in the group the one with the smallest hash. Rows are told apart by id and text,
    so unlinked texts with one id all stay. Texts without words are linked with nothing and stay."""
    adopt(spark)
    found = cut_lineage(minhash.grouped(docs))
    rows = found.where("component is not null").groupBy("component", "doc_id", "version").agg(F.count("*").alias("n"))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "version", "n")).alias("m"))
    blank = found.where("component is null").select("doc_id", "version", F.lit(0).cast("bigint").alias("n")).distinct()
    own, version, times = fresh(docs, "kept_id", "kept_version", "kept_times")
    wanted = first.select("m.doc_id", "m.version", "m.n").union(blank).toDF(own, version, times)
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(own)) & (F.xxhash64(F.col("text").cast("string")) == F.col(version))
    stay = docs.join(wanted, same)
    single = stay.where(F.col(times) <= 1)
    repeated = stay.where(F.col(times) > 1).dropDuplicates([own, version])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return single.select(columns).union(repeated.select(columns))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.without_documents(docs, table(adopt(spark), sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    adopt(spark)
    return mixture.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with their slot and shard."""
    adopt(spark)
    return shard_table.place(docs)[0]


STAGES = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("benchmark_free", benchmark_free),
    ("source_mix", source_mix),
    ("shards", shards),
]

#: Compression and the confirmed near copies have no SQL; tests/llm checks the rows of run() instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(adopt(spark), sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
