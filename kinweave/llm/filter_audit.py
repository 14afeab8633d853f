"""How five document filters overlap, in every order: incremental retraction streaming.

All files of a table run through a stream of available-now micro-batches. A document becomes a mask, a
bit for each filter it fails: A under 100 words, B fewer than 80 distinct words in 100, C over 10 % A-Z,
D one of ``#$%&*|``, E the same text under a smaller id. The first four are seen in the text; E needs all
texts. So each distinct text, known by its SHA-256, has a state: the smallest id so far and the counts of
what its rows with that id were, by part and labels. Rows with a larger id fail E for good. When a smaller
id arrives, the masks counted for the former holders are retracted and counted anew with E. Each
micro-batch's changes are summed to part counters and stored under its number, so a batch that is
repeated after a failure replaces its own. The final masks, at most 32 for each part and pair of labels,
give the effect of all 120 orders.

Rows of one text are combined before they are shuffled, in every task, so a text that holds a third of
all rows sends a few rows a task. The order in which files are read, and how they are split into batches,
does not matter. Null texts are empty ones, null langs the part ``''``. A row without an id never fails E
and is no reason for others; rows that share the smallest id all pass E. A document is good or toxic if
any label row of its id says 1.
"""

from __future__ import annotations

from collections import Counter
from hashlib import sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinweave.llm.common import slices
from kinweave.session import scratch_path

# The filters, in the order of their bits, and the marks of D.
FILTERS = "ABCDE"
MARKS = "#$%&*|"
_E = 16
#: The stream reads an equal share of the files in each of so many micro-batches.
BATCHES = 4
#: So many rows of the table share a state on average: one call per text takes 2.5 ms.
TEXTS = 512

ORDERS = ["".join(p) for p in permutations(FILTERS)]


_MASKED = "id long, part string, key binary, mask int"


def _sums(counted: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(counted, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def own_masks(texts: pa.Array) -> np.ndarray:
    """The bits of A to D for each text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data, at = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]], at - at[0]
    lists = pc.ascii_split_whitespace(texts)
    flat, bounds = lists.flatten(), lists.offsets.to_numpy()
    bounds = bounds.astype(np.int64) - int(bounds[0])
    codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    words = _sums(full, bounds)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))[full]
    distinct = np.bincount(np.unique(doc << 32 | codes[full]) >> 32, minlength=len(texts))
    capitals = _sums((data >= 0x41) & (data <= 0x5A), at)
    marked = _sums(np.isin(data, np.frombuffer(MARKS.encode(), dtype=np.uint8)), at)
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    fails = (words < 100, 100 * distinct < 80 * words, 100 * capitals > 10 * chars, marked > 0)
    return sum((f.astype(np.int32) << bit for bit, f in enumerate(fails)), np.zeros(len(texts), np.int32))


def _mask(batches):
    for batch in batches:
        for rows in slices([batch], 1):
            texts = rows.column(1)
            keys = [sha256(t or b"").digest() for t in texts.cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(2), pa.array(keys, pa.binary()), pa.array(own_masks(texts))],
                names=["id", "part", "key", "mask"],
            )


_COMBINED = "bucket long, key binary, part string, mask int, good boolean, toxic boolean, low long, n_low long, n long"
_CHANGES = "part string, mask int, good boolean, toxic boolean, n long"
_KIND = ["part", "mask", "good", "toxic"]
_HELD = pa.schema([("key", pa.binary()), ("low", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("good", pa.bool_()), ("toxic", pa.bool_()), ("n", pa.int64())])


def _combine(batches):
    """Rows alike in all but the id become one: the smallest id, how many have it, how many there are."""
    by = ["bucket", "key", *_KIND]
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        least = rows.group_by(by, use_threads=False).aggregate([("id", "min")])
        rows = rows.join(least, by, use_threads=False)
        at_least = pc.cast(pc.fill_null(pc.equal(rows.column("id"), rows.column("id_min")), False), pa.int64())
        out = rows.append_column("least", at_least).group_by(by, use_threads=False)
        out = out.aggregate([("id_min", "min"), ("least", "sum"), ("least", "count")])
        out = out.select([*by, "id_min_min", "least_sum", "least_count"]).rename_columns([*by, "low", "n_low", "n"])
        yield from out.combine_chunks().to_batches()


def _load(state: GroupState) -> dict[bytes, tuple[int, dict[tuple, int]]]:
    """For each text of the bucket the smallest id, and the kinds of its rows with that id."""
    held: dict[bytes, tuple[int, dict[tuple, int]]] = {}
    if state.exists:
        for key, low, *kind, n in zip(*(c.to_pylist() for c in pa.ipc.open_stream(bytes(state.get[0])).read_all().columns), strict=True):
            held.setdefault(key, (low, {}))[1][tuple(kind)] = n
    return held


def _save(state: GroupState, held: dict[bytes, tuple[int, dict[tuple, int]]]) -> None:
    rows = [(key, low, *kind, n) for key, (low, kinds) in held.items() for kind, n in kinds.items()]
    columns = zip(*rows, strict=True) if rows else [[] for _ in _HELD]
    table = pa.table([pa.array(list(c), f.type) for c, f in zip(columns, _HELD, strict=True)], schema=_HELD)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _HELD) as out:
        out.write_table(table)
    state.update((sink.getvalue().to_pybytes(),))


def _retract(bucket, frames, state: GroupState):
    """The changes of the counters that this micro-batch's rows bring."""
    import pandas as pd

    changes: Counter = Counter()
    held = _load(state)
    for frame in frames:
        columns = (frame[c].tolist() for c in ("key", *_KIND, "low", "n_low", "n"))
        for key, part, mask, good, toxic, own, n_low, n in zip(*columns, strict=True):
            kind, again = (part, mask, good, toxic), (part, mask | _E, good, toxic)
            if own is None or own != own:
                changes[kind] += n
                continue
            own = int(own)
            low, kinds = held.get(key, (None, {}))
            if low is not None and own > low:
                changes[again] += n
                continue
            if low is None or own < low:
                for before, m in kinds.items():
                    changes[before] -= m
                    changes[(before[0], before[1] | _E, *before[2:])] += m
                kinds = {}
            kinds[kind] = kinds.get(kind, 0) + n_low
            held[key] = (own, kinds)
            changes[kind] += n_low
            changes[again] += n - n_low
    _save(state, held)
    yield pd.DataFrame([(*kind, n) for kind, n in changes.items() if n], columns=[*_KIND, "n"])


def counters(
    spark: SparkSession,
    path: str,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    part: str = "lang",
    batches: int = BATCHES,
) -> DataFrame:
    """``part``, ``mask``, ``good``, ``toxic``, ``n``: how many documents of the Parquet files below ``path``
    have each mask. ``labels``: ``doc_id``, ``quality``, ``toxic``."""
    table = spark.read.parquet(path)
    files, buckets = len(table.inputFiles()), table.count() // TEXTS + 1
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    docs = (
        spark.readStream.schema(table.schema)
        .option("maxFilesPerTrigger", max(1, -(-files // batches)))
        .parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, as streams take one file only by pattern
        .select(
            F.col(f"`{key}`").cast("bigint").alias("id"),
            F.col(f"`{text}`").alias("text"),
            F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        )
        .mapInArrow(_mask, _MASKED)
    )
    told = docs.join(known, F.col("id") == F.col("of"), "left").select(
        F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "part", "mask", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")], "id"
    )
    changes = (
        told.mapInArrow(_combine, _COMBINED)
        .groupBy("bucket")
        .applyInPandasWithState(_retract, _CHANGES, "texts binary", "update", GroupStateTimeout.NoTimeout)
    )
    stored = scratch_path(spark, "filter-counters")

    def store(batch: DataFrame, number: int) -> None:
        batch.groupBy(*_KIND).agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{stored}/batch={number}")

    query = (
        changes.writeStream.foreachBatch(store)
        .outputMode("update")
        .option("checkpointLocation", scratch_path(spark, "filter-stream"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = "part string, mask int, good boolean, toxic boolean, n long, batch int"
    if query.lastProgress is None:
        return spark.createDataFrame([], schema).drop("batch")
    return spark.read.schema(schema).parquet(stored).groupBy(*_KIND).agg(F.sum("n").alias("n")).where("n <> 0")


def effects(counts: DataFrame) -> DataFrame:
    """A row per part, order and step from the counters: what the filter of that step does after the ones
    before it. Every part has 600 rows."""
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("bigint")
    by_mask = counts.groupBy("part", "mask").agg(F.sum("n").alias("all"), n(F.col("good")).alias("good"), n(F.col("toxic")).alias("toxic"))
    orders = F.array(*[F.lit(o) for o in ORDERS])
    rows = by_mask.select("*", F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = F.array(*[F.lit(1 << k) for k in range(len(FILTERS))])

    def bit(at):  # of the filter at a place of the order
        return F.get(bits, F.instr(F.lit(FILTERS), F.col("filter_order").substr(at, F.lit(1))) - 1)

    earlier = F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(5)), lambda i: i < F.col("step")), F.lit(0), lambda a, i: a.bitwiseOR(bit(i)))
    rows = rows.withColumns({"bit": bit(F.col("step")), "earlier": earlier})
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) != 0
    total = lambda when, what="all": F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0)).cast("bigint")
    out = rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    letter = F.col("filter_order").substr(F.col("step"), F.lit(1))
    shares = out.groupBy("part", letter.alias("letter")).agg(F.sum("removed").alias("shapley"))
    out, shares = out.withColumn("letter", letter), shares.withColumnRenamed("part", "of").withColumnRenamed("letter", "by")
    return out.join(shares, (F.col("part") == F.col("of")) & (F.col("letter") == F.col("by"))).drop("letter", "of", "by")


def report(spark: SparkSession, path: str, labels: DataFrame) -> DataFrame:
    return effects(counters(spark, path, labels))
