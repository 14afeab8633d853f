"""Near copies of vectors by iterative quantisation.

A rotation of the principal axes is learned so that signs are balanced and lose little (ITQ); its sign
bits are the code. Codes are cut into substrings, each the key of one Hamming table; vectors of one
label that share a substring are candidates and are compared by cosine with their original values in
double precision.

``key_bits`` grows with the vectors of the largest label, to keep about ``FILL`` under a key. A pair at
the threshold agrees in a bit with probability 1 - acos(threshold) / pi, which gives the number of tables
that ``RECALL`` needs; the bits for them come from as many learned rotations as needed.

Identical vectors of a label are one class. A key with many classes is cut into blocks whose pairs are
matrix products; out of a block come numbers of links and a spanning star of each group, never all its
pairs. A pair counts in the first table it shares only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from kinweave.llm.components import components
from kinweave.session import cut_lineage

THRESHOLD = 0.93
RECALL = 0.995
FILL = 32
#: The fit's sample: the vectors with the smallest hashes.
SAMPLE = 20_000
ROUNDS = 30
BLOCK = 512


def fit(sample: np.ndarray, rotations: int, rounds: int = ROUNDS) -> np.ndarray:
    """Rotations matrices side by side, each of the principal axes turned so that the signs of the projected
    sample differ least from its values. The mean stays in: without it the angles between vectors of one
    narrow group would grow, and near copies in it would share no more bits than others."""
    # a sample smaller than the width spans fewer axes; the others complete them
    axes = np.linalg.svd(sample, full_matrices=len(sample) < sample.shape[1])[2].T
    projected, out = sample @ axes, []
    for k in range(rotations):
        turn = np.linalg.qr(np.random.default_rng(k).normal(size=(axes.shape[1], axes.shape[1])))[0]
        for _ in range(rounds):
            signs = np.where(projected @ turn >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(signs.T @ projected)
            turn = (u @ v).T
        out.append(axes @ turn)
    return np.concatenate(out, axis=1)


def tables_for(vectors: int, threshold: float, fill: int = FILL, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a key, number of tables) for that many vectors under one label."""
    bits = min(24, max(8, math.ceil(math.log2(max(1, vectors) / fill))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length one, in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = x.astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(threshold: float, number: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                left, right, table = row["left"], row["right"], row["tab"]
                x, y = (_unit(np.frombuffer(b"".join(v["vec"] for v in side), number).reshape(len(side), -1)) for side in (left, right))
                like = x @ y.T >= threshold
                if row["same"]:
                    like &= ~np.eye(len(x), dtype=bool)
                p, q = (np.frombuffer(b"".join(v["keys"] for v in side), "<i4").reshape(len(side), -1) for side in (left, right))
                new = like.copy()
                for t in range(table):
                    new &= p[:, t, None] != q[None, :, t]
                m_l, m_r = (np.array([v["m"] for v in side]) for side in (left, right))
                cls_l, cls_r = (np.array([v["cls"] for v in side]) for side in (left, right))
                links = [(cls_l, new @ m_r)] + ([] if row["same"] else [(cls_r, new.T @ m_l)])
                i, j = np.nonzero(like)
                spot = np.arange(len(x) + (0 if row["same"] else len(y)))
                j = j if row["same"] else j + len(x)
                every = cls_l if row["same"] else np.concatenate([cls_l, cls_r])
                while True:
                    least = np.minimum(spot[i], spot[j])
                    moved = spot.copy()
                    np.minimum.at(moved, i, least)
                    np.minimum.at(moved, j, least)
                    if (moved == spot).all():
                        break
                    spot = moved
                out = np.flatnonzero(spot != np.arange(len(spot)))
                cls = np.concatenate([c[n > 0] for c, n in links] + [every[out]])
                n = np.concatenate([n[n > 0] for _, n in links] + [np.zeros(len(out), dtype=np.int64)])
                to = [None] * (len(cls) - len(out)) + every[spot[out]].tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(to, pa.int64())], names=["cls", "n", "other"]
                )

    return run


def near_copies(
    vectors: DataFrame, threshold: float = THRESHOLD, vec: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id reachable) and kept.

    Only vectors of one label and length are compared, as doubles; an array of floats travels as floats. A vector that is null or zero, holds a null or a value that is not finite, or has no label links with nothing: its component is its
    own id. Repeated rows are vectors of their own; a null id never names a component of others.
    """
    spark = vectors.sparkSession
    plain = vectors.schema[embedding].dataType
    narrow = isinstance(plain, ArrayType) and isinstance(plain.elementType, FloatType)
    values, number = F.col(embedding).cast("array<float>" if narrow else "array<double>"), "<f4" if narrow else "<f8"
    sound = (
        F.col(label).isNotNull() & values.isNotNull() & (F.size(values) > 0)
        & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(values, lambda v: v != 0)
    )
    rows = vectors.select(
        F.col(vec).cast("bigint").alias("vec_id"), F.col(label).cast("string").alias("label"), values.alias("v"),
        F.coalesce(sound, F.lit(False)).alias("sound"),
    )
    rows = rows.withColumn("cls", F.when(F.col("sound"), F.xxhash64("label", "v")))
    classes = rows.where("cls is not null").groupBy("cls")
    classes = classes.agg(F.min("vec_id").alias("least"), F.count("*").alias("m"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = cut_lineage(classes.withColumn("label", F.concat(F.size("v").cast("string"), F.lit(" "), "label")))
    largest = classes.groupBy(F.size("v").alias("d"), "label").count().groupBy("d").agg(F.max("count")).collect()
    models = {}
    for width, n in largest:  # lengths, few beside the vectors
        bits, tables = tables_for(n, threshold)
        sample = classes.where(F.size("v") == width).select("cls", "v").orderBy("cls").limit(SAMPLE).toPandas()["v"].tolist()
        sample = _unit(np.array(sample, dtype=float).reshape(-1, width))
        models[width] = (bits, tables, fit(sample, math.ceil(bits * tables / width)))
    model = spark.sparkContext.broadcast(models)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mixed in batches:
            lengths = pc.list_value_length(mixed.column(3))
            for width in pc.unique(lengths).to_pylist():
                yield coded(mixed.filter(pc.equal(lengths, width)), width)

    def coded(batch: pa.RecordBatch, width: int) -> pa.RecordBatch:
        bits, tables, turn = model.value[width]
        weights = 1 << np.arange(bits, dtype=np.int64)
        x = np.array(batch.column(3).flatten().to_numpy(zero_copy_only=False), dtype=number).reshape(-1, width)
        code = (_unit(x) @ turn >= 0)[:, : bits * tables].reshape(len(x), tables, bits)
        own = (code * weights).sum(axis=2).astype("<i4")
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), batch.column(2),
                pa.array([v.tobytes() for v in x], pa.binary()),
                pa.array([k.tobytes() for k in own], pa.binary()),
                pa.array(own.tolist(), pa.list_(pa.int32())),
            ],
            names=["cls", "label", "m", "vec", "keys", "each"],
        )

    placed = cut_lineage(
        classes.select("cls", "label", "m", "v").mapInArrow(keys, "cls bigint, label string, m bigint, vec binary, keys binary, each array<int>")
    )
    spread = placed.select("cls", "label", "m", "vec", "keys", F.posexplode("each").alias("tab", "key"))
    bucket = ["label", "tab", "key"]
    counts = placed.select("label", F.posexplode("each").alias("tab", "key")).groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1")
    block = F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / BLOCK)).cast("int")
    blocks = (
        spread.join(counts, bucket)
        .withColumn("block", block)
        .groupBy(*bucket, "block")
        .agg(F.collect_list(F.struct("cls", "m", "vec", "keys")).alias("rows"))
    )  # a block has about BLOCK rows
    blocks = cut_lineage(blocks)
    left = blocks.select(*bucket, F.col("block").alias("i"), F.col("rows").alias("left"))
    right = blocks.select(*bucket, F.col("block").alias("j"), F.col("rows").alias("right"))
    pairs = left.join(right, bucket).where("i <= j").select("tab", "left", "right", (F.col("i") == F.col("j")).alias("same"))
    found = cut_lineage(pairs.mapInArrow(_compare(threshold, number), "cls bigint, n bigint, other bigint"))
    near = components(found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    links = found.where("other is null").groupBy("cls").agg(F.sum("n").alias("n"))
    grouped = classes.select("cls", "least", "m").join(near, F.col("cls") == F.col("node"), "left").join(links, "cls", "left")
    grouped = grouped.select("cls", "least", "m", "n", F.coalesce("component", "cls").alias("component"))
    lowest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(lowest, "component").select("cls", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    out = rows.where("cls is not null").select("vec_id", "cls").join(named, "cls").select("vec_id", "n_links", "component_id")
    alone = rows.where("cls is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
