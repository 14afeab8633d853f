"""Small helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of anything but the six ASCII white-space characters, for Java's regular expressions.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def id_remainder(column: str, modulus: int, value: int) -> Column:
    """Whether crc32 of the id, written as text, leaves ``value``; a null id does not."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == value, F.lit(False))


def slices(batches: Iterable[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterable[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of that column, or of one longer row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def byte_words(texts: pa.Array) -> list[list[bytes]]:
    """Each text's words between ASCII white space, A-Z in lower case; none for null."""
    return [t.lower().split() if t else [] for t in texts.cast(pa.binary()).to_pylist()]


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The same words without Python objects: a code per word over all texts, where each text's codes
    start (one more entry than texts), and the distinct words the codes stand for."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    bounds = lists.offsets.to_numpy()
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    coded = flat.filter(full).dictionary_encode()
    return coded.indices.to_numpy(), kept[bounds - bounds[0]].astype(np.int64), coded.dictionary


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of the strings of an Arrow array, the same in every batch."""
    words = words.cast(pa.large_binary())
    if len(words) == 0:
        return np.empty(0, dtype=np.uint64)
    start = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[start[0] : start[-1]]
    length = np.diff(start)
    place = np.arange(len(data)) - np.repeat(start[:-1] - start[0], length)
    factor = np.full(int(length.max(initial=0)) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64).cumprod()
    terms = np.append(mixed(data.astype(np.uint64) + np.uint64(1)) * factor[place], np.uint64(0))
    sums = np.where(length > 0, np.add.reduceat(terms, start[:-1] - start[0]), np.uint64(0))
    return mixed(sums + length.astype(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of splitmix64)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
