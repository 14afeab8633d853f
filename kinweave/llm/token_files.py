"""Token ids in flat files: unsigned integers one after the other, and 64-bit document offsets beside them.

A token store is a folder in the shared file system. Each part has three little-endian files:
``<part>.ids`` (uint16 where the vocabulary fits, else uint32), ``<part>.offsets`` (int64: for each
document the ids of all documents before it in the whole store, and the end of the last one) and
``<part>.doc`` (int64 document ids; the smallest int64 stands for null). Parts are ascending in
document id. The parts that count are those of the returned table: a task that was run twice leaves a
file that no row names.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from struct import Struct

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import slices
from kinweave.session import cut_lineage

#: So many pieces of text are remembered per Python worker, and as many that were used before those.
MEMORY = 600_000
NO_DOC = -(2**63)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _save(uri: str, array: np.ndarray) -> None:
    store, path = file_system(uri)
    with store.open_output_stream(path) as out:
        out.write(memoryview(array).cast("B") if len(array) else b"")


def _load(uri: str, dtype: str) -> np.ndarray:
    """Mapped into memory where the file is local, else read."""
    store, path = file_system(uri)
    if store.get_file_info(path).size == 0:
        return np.empty(0, dtype)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with store.open_input_file(path) as source:
        return np.frombuffer(source.read_buffer(), dtype)


class Encoder:
    """Ids of whole texts. The vocabulary's normaliser and splitter never join or look across a space or
    line feed, so the pieces between them are encoded once and put together again. Spark keeps its Python workers,
    and a worker keeps its encoder from task to task (``worker_encoder``)."""

    def __init__(self, vocabulary: str, dtype: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(vocabulary)
        size = int(dtype[2:])
        form = {k: Struct(f"<{k}{'H' if size == 2 else 'I'}").pack for k in range(1, 9)}
        # most pieces have few ids, for which an array each costs more than the ids
        self.packed = lambda ids: form[len(ids)](*ids) if len(ids) in form else np.array(ids, dtype=dtype).tobytes()
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        pieces = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        if len(self.known) > MEMORY:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        new = set().union(*pieces).difference(known)
        again = new.intersection(before)
        known.update((p, before[p]) for p in again)
        new = list(new - again)
        for piece, coded in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            known[piece] = self.packed(coded.ids)
        return [b"".join(map(known.__getitem__, ps)) for ps in pieces]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def worker_encoder(vocabulary: str, dtype: str) -> Encoder:
    """This Python worker's encoder of a vocabulary; another vocabulary replaces it."""
    key = (vocabulary, dtype)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary, dtype)
    return _ENCODERS[key]


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode the whole texts (null: no ids), append ``end_id`` to each document, and write the store.

    Returns one row per part: its path, dtype, number of documents and ids, and ids before it.
    Documents with equal ids stay apart, in the order of their texts' hashes and texts; null ids come
    first. ``vocabulary`` is the JSON of a tokenizers file.
    """
    spark = docs.sparkSession
    size = 1 + max(list(json.loads(vocabulary)["model"]["vocab"].values()) + [t["id"] for t in json.loads(vocabulary).get("added_tokens", [])] + [end_id])
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast(vocabulary)
    store, path = file_system(folder)
    store.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value, dtype)
        end = np.array([end_id], dtype=dtype).tobytes()
        part = TaskContext.get().partitionId()
        name = f"{folder}/{part:08d}-{uuid.uuid4().hex}"
        store, path = file_system(f"{name}.ids")
        lengths, ids = [], []
        with store.open_output_stream(path) as out:
            for batch in slices(batches, 1):
                coded = [c + end for c in encoder.encode(batch.column(1).to_pylist())]
                out.write(b"".join(coded))
                lengths += [len(c) // len(end) for c in coded]
                ids += batch.column(0).fill_null(NO_DOC).to_pylist()
        _save(f"{name}.start", np.concatenate([[0], np.cumsum(lengths)]).astype("<i8"))
        _save(f"{name}.doc", np.array(ids, dtype="<i8"))
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [name], "n_docs": [len(ids)], "n_ids": [sum(lengths)]})

    order = [F.col(doc), F.xxhash64(text), F.col(text)]
    placed = docs.select(F.col(doc).cast("bigint").alias(doc), F.col(text).cast("string").alias(text))
    parts = cut_lineage(
        placed.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
        .mapInArrow(run, "part bigint, path string, n_docs bigint, n_ids bigint")
    )
    rows = sorted(parts.where("n_docs > 0").collect())  # a row per part
    bases = np.concatenate([[0], np.cumsum([r.n_ids for r in rows])]).tolist()
    table = [(k, r.path, dtype, r.n_docs, r.n_ids, base) for k, (r, base) in enumerate(zip(rows, bases, strict=False))]
    manifest = spark.createDataFrame(table, "part bigint, path string, dtype string, n_docs bigint, n_ids bigint, base bigint")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():  # written under another name, so that a second attempt starts from the same
                _save(f"{row['path']}.offsets", np.array(_load(f"{row['path']}.start", "<i8")) + row["base"])
            yield batch

    return cut_lineage(manifest.repartition(max(1, len(rows))).mapInArrow(place, manifest.schema))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row per document of the store: doc_id, start, n_tokens and the crc32 of its ids as
    little-endian unsigned 32-bit integers, all from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = _load(f"{row['path']}.ids", row["dtype"])
                starts = _load(f"{row['path']}.offsets", "<i8")
                docs = np.array(_load(f"{row['path']}.doc", "<i8"))
                for at in range(0, len(docs), 4096):
                    own = np.array(starts[at : at + 4097])
                    bounds = (own - row["base"]).tolist()
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds, bounds[1:], strict=False)]
                    some = docs[at : at + 4096]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(some, pa.int64(), mask=some == NO_DOC),
                            "start": pa.array(own[:-1], pa.int64()),
                            "n_tokens": pa.array(np.diff(own), pa.int64()),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        }
                    )

    many = max(1, manifest.count())
    return manifest.repartition(many).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
