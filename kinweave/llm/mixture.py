"""Mixing sources to target weights by nested hash thresholds.

A source of weight w gets its share of all words, at most ``most`` times its own; what a full source
leaves is shared by the others by weight. A document is taken floor(target / size) times, and once
more where its hash is below its source's threshold. Thresholds come from histograms: words are
summed by source and hash bucket, the bucket in which the budget ends is refined with the next bits of
the hash, and nothing is sorted. A larger budget only ever adds documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import SPACED_WORD, fresh
from kinweave.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
#: Bits of the hash that each histogram adds, and how often: 4096 buckets for each source at a time.
BITS = 12
LEVELS = 4
#: Sources beyond this number are refused: their table is held by the driver and broadcast.
MAX_SOURCES = 1_000_000


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(SPACED_WORD)), F.lit(0)).cast("bigint")


def hash_of(doc: str, text: str, seed: int) -> Column:
    """48 bits that depend on the seed, the id and the whole text only."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (doc, text)]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", F.lit(seed), parts[0], F.md5(parts[1]))), 1, 12), 16, 10).cast("bigint")


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Each source's words in the mix: shares of the sum by weight, none above ``most`` times its size."""
    out = [0.0] * len(sizes)
    left, open_ = float(sum(sizes)), [k for k, s in enumerate(sizes) if s > 0]
    while open_:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if left * weights[k] / total > most * sizes[k]]
        for k in full or open_:
            out[k] = most * sizes[k] if full else left * weights[k] / total
        if not full:
            break
        left -= sum(out[k] for k in full)
        open_ = [k for k in open_ if k not in set(full)]
    return out


def plan(docs: DataFrame, doc: str, text: str, source: str, weights: tuple[float, ...], most: float, seed: int) -> DataFrame:
    """A narrow row per document, with ``_doc``, ``_source``, ``_size``, ``_h`` (48 bits) and, for its
    source, ``_source_size``, ``_target``, ``_copies`` and ``_below``: taken copies times, once more
    where ``_h < _below``."""
    spark = docs.sparkSession
    cut = cut_lineage(
        docs.select(
            F.col(doc).alias("_doc"),
            F.col(source).cast("string").alias("_source"),
            words(text).alias("_size"),
            hash_of(doc, text, seed).alias("_h"),
        )
    )
    totals = cut.groupBy("_source").agg(F.sum("_size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = sorted(totals, key=lambda r: (r._source is None, r._source or ""))
    sizes = [r.n for r in rows]
    goals = targets(sizes, [weights[k % len(weights)] for k in range(len(rows))], most)
    state = []
    for row, size, goal in zip(rows, sizes, goals, strict=True):
        copies = int(goal // size) if size else 0
        whole = copies * size
        state.append([row._source, size, goal, copies, 0, goal - whole, size == 0 or goal <= whole])
    schema = "_source string, _source_size bigint, _target double, _copies int, _below bigint"
    width = BITS * LEVELS
    for level in range(1, LEVELS + 1):
        shift = width - BITS * level
        open_ = [(s[0], s[4] >> (shift + BITS)) for s in state if not s[6]]
        if not open_:
            break
        # the bucket still open in each source, cut into the next 2 ** BITS
        edge = F.broadcast(spark.createDataFrame(open_, "_edge_source string, _edge bigint"))
        inside = cut.join(edge, F.col("_source").eqNullSafe(F.col("_edge_source")) & (F.shiftright("_h", shift + BITS) == F.col("_edge")))
        sums = inside.groupBy("_source", F.shiftright("_h", shift).alias("b")).agg(F.sum("_size").alias("n"))
        up_to = sums.withColumn("sum", F.sum("n").over(Window.partitionBy("_source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)))
        left = F.broadcast(spark.createDataFrame([(s[0], float(s[5])) for s in state if not s[6]], "_left_source string, left double"))
        ends = (
            up_to.join(left, F.col("_source").eqNullSafe(F.col("_left_source")))
            .groupBy("_source")
            .agg(
                F.min(F.when(F.col("sum") > F.col("left"), F.struct("b", "n", "sum"))).alias("end"),
                F.max("sum").alias("all"),
            )
            .collect()
        )
        found = {r._source: r for r in ends}
        for s in state:
            if s[6]:
                continue
            row = found.get(s[0])
            if row is None or row.end is None:  # the whole open bucket fits
                s[4] = ((s[4] >> (shift + BITS)) + 1) << (shift + BITS)
                s[6] = True
                continue
            before = row.end["sum"] - row.end["n"]
            s[4], s[5] = row.end["b"] << shift, s[5] - before
            if level == LEVELS:  # one hash value: in where that is nearer to the target
                s[4] += int(2 * s[5] > row.end["n"])
    goals = F.broadcast(spark.createDataFrame([tuple(s[:5]) for s in state], schema).withColumnRenamed("_source", "_goal_source"))
    return cut.join(goals, F.col("_source").eqNullSafe(F.col("_goal_source"))).drop("_goal_source")


def _times() -> Column:
    return F.col("_copies") + (F.col("_h") < F.col("_below")).cast("int")


def mix(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 9) -> DataFrame:
    """The mix itself: every document as often as it is taken (0 to ``most`` times), with its own columns.

    Rows with the same id and text have one hash and are taken together. A null text has no words; a
    null source is a source of its own. Documents without words are taken like the others of their
    source: they cost nothing.
    """
    planned = plan(docs, doc, text, source, weights, most, seed)
    goals = planned.groupBy("_source").agg(F.first("_copies").alias("_copies"), F.first("_below").alias("_below"))
    names = fresh(docs, "mix_source", "mix_copies", "mix_below", "mix_hash", "mix_turn")
    few = F.broadcast(goals.select(*[F.col(c).alias(n) for c, n in zip(("_source", "_copies", "_below"), names, strict=False)]))
    times = F.col(names[1]) + (F.col(names[3]) < F.col(names[2])).cast("int")
    return (
        docs.join(few, F.col(source).cast("string").eqNullSafe(F.col(names[0])))
        .withColumn(names[3], hash_of(doc, text, seed))
        .where(times > 0)
        .withColumn(names[4], F.explode(F.sequence(F.lit(1), times)))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every document."""
    planned = plan(docs, "doc_id", "text", "source", WEIGHTS, MOST, 9)
    return planned.select(
        F.col("_doc").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * _times()).alias("taken"),
    )
