"""Benchmark decontamination: windows of normalised benchmark words are broadcast and looked up in the texts.

The benchmark is cut into blocks of at most ``block_words`` words (a longer item is a block of its
own), which bounds each broadcast; every document passes all blocks within one stage, without a
shuffle. Words become ids of the block's vocabulary. Only stretches of known words that begin as some
window does are looked up, and a lookup compares the whole window.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.common import fresh, slices

WINDOW = 10
BLOCK_WORDS = 2_000_000

#: Everything that is no digit, letter a-z or part of a non-ASCII character parts words.
_APART = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text: bytes | None) -> list[bytes]:
    return text.lower().translate(_APART).split() if text else []


def _ascii_lower(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


class Windows:
    """The windows of one block of items: ``by_length[n]`` has the ids of n words as bytes -> item numbers."""

    def __init__(self, window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[str | None] = []
        self.by_length: dict[int, dict[bytes, set[int]]] = defaultdict(lambda: defaultdict(set))
        self.starts: dict[int, np.ndarray] = {}

    def add(self, item: str | None, words: list[bytes]) -> None:
        ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.int32)
        size = min(self.window, len(ids))
        for at in range(len(ids) - size + 1):
            self.by_length[size][ids[at : at + size].tobytes()].add(len(self.items))
        self.items.append(item)

    def close(self) -> Windows:
        for size, windows in self.by_length.items():
            first = np.zeros(len(self.vocabulary) + 1, dtype=bool)
            for key in windows:
                first[np.frombuffer(key[:4], dtype=np.int32)[0]] = True
            self.starts[size] = first
        self.by_length = {size: dict(windows) for size, windows in self.by_length.items()}
        return self

    def find(self, texts: list[list[bytes]]) -> tuple[list[list[int]], list[list[str]]]:
        """For each text the places of its hit words and the items found."""
        ids: list[int] = []
        bounds = [0]
        known = self.vocabulary.get
        for words in texts:
            ids.extend([known(w, 0) for w in words])
            ids.append(0)  # no window reaches over the end of a text
            bounds.append(len(ids))
        code = np.array(ids, dtype=np.int32)
        unknown = np.concatenate([[0], np.cumsum(code == 0)])
        hit = np.zeros(len(code), dtype=bool)
        found: dict[int, set[str]] = defaultdict(set)
        for size, windows in self.by_length.items():
            if len(code) < size:
                continue
            at = np.flatnonzero((unknown[size:] == unknown[:-size]) & self.starts[size][code[: len(code) - size + 1]])
            for i, text in zip(at.tolist(), (np.searchsorted(bounds, at, "right") - 1).tolist(), strict=True):
                items = windows.get(code[i : i + size].tobytes())
                if items:
                    hit[i : i + size] = True
                    found[text].update(self.items[n] for n in items if self.items[n] is not None)
        places: list[list[int]] = [[] for _ in texts]
        at = np.flatnonzero(hit)
        for i, text in zip(at.tolist(), (np.searchsorted(bounds, at, "right") - 1).tolist(), strict=True):
            places[text].append(i - bounds[text])
        return places, [sorted(found.get(k, ())) for k in range(len(texts))]


def _blocks(benchmark: DataFrame, item: str, text: str, window: int, block_words: int) -> Iterator[Windows]:
    block, held = Windows(window), 0
    for row in benchmark.select(F.col(item).cast("string"), F.col(text).cast("binary")).toLocalIterator():
        words = _words(bytes(row[1]) if row[1] is not None else None)
        if held and held + len(words) > block_words:
            yield block.close()
            block, held = Windows(window), 0
        if words:
            block.add(row[0], words)
            held += len(words)
    yield block.close()


def mark(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> tuple[DataFrame, str, str, str]:
    """``docs`` with three more columns, whose names are returned too: the number of words, the places
    of the words inside any occurring window (ascending), and the ids of the items with such a window.

    A null or empty text has no words. Items without words never occur; a null item id marks words but
    is not listed; repeated item ids are one item. Repeated documents are marked each for itself.
    """
    n_words, hits, items = fresh(docs, "n_words", "hit_words", "hit_items")
    out = docs.select("*", F.lit(0).cast("bigint").alias(n_words), F.array().cast("array<int>").alias(hits), F.array().cast("array<string>").alias(items))
    width = len(docs.columns)
    at = [c.lower() for c in docs.columns].index(text.lower())
    names = out.columns
    out = out.toDF(*[f"c{k}" for k in range(len(names))])  # mapInArrow takes no names with dots
    schema = T.StructType(list(out.schema))
    for block in _blocks(benchmark, item, item_text, window, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in slices(batches, at):
                words = [_words(t) for t in batch.column(at).cast(pa.binary()).to_pylist()]
                places, found = block.find(words)
                before = zip(batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist(), places, found, strict=True)
                merged = [(sorted({*a, *p}) if a else p, sorted({*b, *f}) if b else f) for a, b, p, f in before]
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[:width],
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.array([m[0] for m in merged], pa.list_(pa.int32())),
                        pa.array([m[1] for m in merged], pa.list_(pa.string())),
                    ],
                    names=batch.schema.names,
                )

        out = out.mapInArrow(run, schema)
    return out.toDF(*names), n_words, hits, items


def without_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no window occurs, with their own columns."""
    out, _, hits, _ = mark(docs, benchmark, **options)
    return out.where(F.size(hits) == 0).select(*[out[f"`{c}`"] for c in docs.columns])


def without_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """All documents; hit words are cut from the text, each stretch of them with all between its words."""
    out, _, hits, _ = mark(docs, benchmark, text=text, **options)

    def cut(text: str, places: list[int]) -> str:
        spans = [m.span() for m in _WORD.finditer(_ascii_lower(text))]
        kept, at, last = [], 0, None
        for k in places:
            if last is None or k != last + 1:
                kept.append(text[at : spans[k][0]])
            at, last = spans[k][1], k
        return "".join([*kept, text[at:]])

    @F.pandas_udf("string")
    def cut_all(texts, places):
        return texts.combine(places, lambda t, p: cut(t, list(p)) if len(p) else t)

    cleaned = cut_all(F.col(text), F.col(hits))
    return out.select(*[cleaned.alias(c) if c.lower() == text.lower() else out[f"`{c}`"] for c in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out, n_words, hits, items = mark(docs.select("doc_id", "text"), benchmark)
    return out.select(
        "doc_id",
        F.col(n_words).alias("n_words"),
        F.size(hits).cast("bigint").alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        (F.size(hits) > 0).alias("contaminated"),
    )
