"""Ranked lexical search by pipelined term partitioning.

Documents are cut into blocks and indexed once: a row for each term of a block, with its documents and
frequencies. Terms are dealt to owners by the share of documents that hold them, the rarest ones first.
Items travel in bundles: a bundle has one row for each block, with the sparse accumulators (item, document
-> score) it has gathered there. Stage by stage that row meets, by ``cogroup``, the postings of the next
owner that the bundle asks for; their integer contributions are added, and the row moves on. An
accumulator is left behind only if what its item's later owners can still add, at most, does not
bring it to the score that enough documents of its own block have already; so no result is lost. The last
stage gives each item's best documents of each block, from which the best of all are taken.

No group is larger than a bundle of ``BUNDLE`` items in a block of ``BLOCK_DOCS`` documents, however common
a term is. Words are known by 64-bit hashes; two words of one hash would be taken as one. Null texts and
texts without a term are not indexed; items without one return nothing; an item that is repeated is
answered each time. Documents with one id are documents of their own. Ids are integers or null, null first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.common import coded_words, hashes, slices
from kinweave.session import cut_lineage

BEST = 50
BUNDLE = 256
BLOCK_DOCS, BLOCK_BYTES = 4_096, 8 << 20
#: The shares of documents up to which a term belongs to each owner but the last.
OWNERS = (1 / 64, 1 / 16, 1 / 4)
#: Up to so many distinct terms of items, 8 bytes each, the index leaves out all others; beyond, it has every term.
WANTED = 1_000_000
#: A term adds less than this times its weight.
MOST = 1_000_000

#: Digits, letters and the bytes of non-ASCII characters make terms; A-Z in lower case.
_TERM = np.array(
    [b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)],
    dtype=np.uint8,
)


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A code for each term of all texts, the bounds of each text's codes, and the hashes of the codes."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]
    clean = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(_TERM[data]))
    codes, bounds, distinct = coded_words(clean)
    return codes.astype(np.int64), bounds, hashes(distinct).view(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch], column: int, rows: int, size: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows in pieces of at most so many rows and bytes, numbered apart over all tasks."""
    number = TaskContext.get().partitionId() << 33
    for part in slices(batches, column, size):
        for start in range(0, part.num_rows, rows):
            yield number, part.slice(start, rows)
            number += 1


_INDEX = "block long, term long, docs array<int>, times array<int>, ids array<long>, sizes array<long>"


def index(docs: DataFrame, key: str, text: str, wanted=None) -> DataFrame:
    """For each block a row per term with the places of its documents in the block and its frequencies there,
    and a row without a term that has the documents' ids and sizes in terms. ``wanted``: a broadcast sorted
    array of the hashes of all terms that need rows; None for all."""
    schema = pa.schema(
        [("block", pa.int64()), ("term", pa.int64())]
        + [(n, pa.list_(pa.int32())) for n in ("docs", "times")]
        + [(n, pa.list_(pa.int64())) for n in ("ids", "sizes")]
    )

    def blocks(batches):
        for number, part in _pieces(batches, 1, BLOCK_DOCS, BLOCK_BYTES):
            codes, bounds, terms = _coded(part.column(1))
            sizes = np.diff(bounds)
            full = sizes > 0
            if not full.any():
                continue
            kept = int(full.sum())
            doc = np.repeat(np.cumsum(full) - 1, sizes)
            if wanted is not None:
                known = wanted.value
                asked = known[np.minimum(np.searchsorted(known, terms), len(known) - 1)] == terms if len(known) else np.zeros(len(terms), bool)
                held = asked[codes]
                codes, doc = codes[held], doc[held]
            pairs, times = np.unique(codes * kept + doc, return_counts=True)
            code = pairs // kept
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            offsets = pa.array(np.append(starts, len(pairs)), pa.int32())
            n = len(starts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, number)),
                    pa.array(terms[code[starts]], pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(pairs % kept, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
                    pa.nulls(n, schema.field("ids").type),
                    pa.nulls(n, schema.field("sizes").type),
                ],
                schema=schema,
            )
            one = pa.array([0, kept], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number]),
                    pa.nulls(1, pa.int64()),
                    pa.nulls(1, schema.field("docs").type),
                    pa.nulls(1, schema.field("times").type),
                    pa.ListArray.from_arrays(one, part.column(0).filter(pa.array(full))),
                    pa.ListArray.from_arrays(one, pa.array(sizes[full], pa.int64())),
                ],
                schema=schema,
            )

    columns = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    return cut_lineage(columns.mapInArrow(blocks, _INDEX))


def bundles(items: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each term of each item: ``bundle``, ``slot`` (the item's place in it), ``item`` and ``term``."""
    schema = T.StructType(
        [
            T.StructField("bundle", T.LongType()),
            T.StructField("slot", T.IntegerType()),
            T.StructField("item", items.schema[key].dataType),
            T.StructField("term", T.LongType()),
        ]
    )

    def terms(batches):
        for number, part in _pieces(batches, 1, BUNDLE, BLOCK_BYTES):
            codes, bounds, distinct = _coded(part.column(1))
            slot = np.repeat(np.arange(part.num_rows), np.diff(bounds))
            pairs = np.unique(slot * max(1, len(distinct)) + codes)
            slot, code = np.divmod(pairs, max(1, len(distinct)))
            slot = pa.array(slot, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(pairs), number)), slot, part.column(0).take(slot), pa.array(distinct[code])],
                names=schema.names,
            )

    return cut_lineage(items.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(terms, schema))


_STATE = (
    "bundle long, block long, ids array<long>, sizes array<long>, rest array<array<long>>, "
    "places array<int>, scores array<long>"
)
_LONGS = pa.list_(pa.int64())
_STATE_TYPES = pa.schema(
    [("bundle", pa.int64()), ("block", pa.int64()), ("ids", _LONGS), ("sizes", _LONGS), ("rest", pa.list_(_LONGS))]
    + [("places", pa.list_(pa.int32())), ("scores", _LONGS)]
)
_FOUND = "bundle long, block long, slot int, doc_id long, score long"


def _values(table: pa.Table, name: str, row: int = 0) -> np.ndarray:
    return table.column(name)[row].values.to_numpy(zero_copy_only=False)


def _stage(owner: int, documents: int, terms: int, best: int, last: bool):
    """What one owner does with a bundle's row of one block."""

    def visit(bundle: pa.Table, postings: pa.Table) -> pa.Table:
        ids = bundle.column("ids")[0].values
        count = len(ids)
        scores = np.zeros(BUNDLE * count, dtype=np.int64)
        scores[_values(bundle, "places")] = _values(bundle, "scores")
        mean = 50 + 50 * _values(bundle, "sizes") * documents // terms
        slots, weights = postings.column("slots"), postings.column("weight").to_numpy()
        for row, weight in enumerate(weights):
            docs, times = _values(postings, "docs", row), _values(postings, "times", row).astype(np.int64)
            added = weight * (1_000_000_000 * times // (1000 * times + 20 * mean[docs]))
            for slot in slots[row].as_py():
                scores[slot * count + docs] += added  # a document stands once in a row
        table = scores.reshape(BUNDLE, count)
        rest = bundle.column("rest")[0].as_py()
        for slot in np.flatnonzero(table.any(axis=1)):
            own = table[slot]
            if np.count_nonzero(own) > best:
                enough = np.partition(own, count - best)[count - best]
                own[own + (0 if last else rest[slot][owner] * MOST) < enough] = 0
        places = np.flatnonzero(scores)
        if last:
            return _best(bundle, places // count, ids.take(pa.array(places % count)), scores[places], best)
        out = bundle.select(["bundle", "block", "ids", "sizes", "rest"])
        out = out.append_column("places", pa.array([places.astype(np.int32)], pa.list_(pa.int32())))
        out = out.append_column("scores", pa.array([scores[places]], pa.list_(pa.int64())))
        return out.cast(_STATE_TYPES)  # Spark's arrays without nulls are not nullable

    return visit


def _best(bundle: pa.Table, slot: np.ndarray, ids: pa.Array, scores: np.ndarray, best: int) -> pa.Table:
    known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
    value = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    order = np.lexsort((value, known, -scores, slot))
    slot = slot[order]
    first = np.flatnonzero(np.diff(slot, prepend=-1))
    rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
    kept = order[rank < best]
    n = len(kept)
    key = [pa.array(np.full(n, bundle.column(c)[0].as_py()), pa.int64()) for c in ("bundle", "block")]
    slots = pa.array(slot[rank < best], pa.int32())
    return pa.table([*key, slots, ids.take(pa.array(kept)), pa.array(scores[kept])], names=["bundle", "block", "slot", "doc_id", "score"])


def _wanted(asked: DataFrame):
    terms = asked.select("term").distinct()
    if terms.count() > WANTED:
        return None
    known = np.sort(terms.toArrow().column(0).to_numpy()).astype(np.int64)
    return asked.sparkSession.sparkContext.broadcast(known)


def search(
    docs: DataFrame,
    items: DataFrame,
    best: int = BEST,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Each item's ``best`` documents with a score above 0: ``item_id``, ``rank``, ``doc_id``, ``score``."""
    asked = bundles(items, item, item_text)
    rows = index(docs, key, text, _wanted(asked))
    blocks = rows.where("term is null").select("block", "ids", "sizes")
    postings = rows.where("term is not null").select("block", "term", "docs", "times")
    documents, terms = blocks.agg(
        F.coalesce(F.sum(F.size("ids")), F.lit(0)),
        F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0)),
    ).first()

    spread = postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    owner = F.lit(len(OWNERS))
    for n, share in reversed(list(enumerate(OWNERS))):
        owner = F.when(F.col("df") <= share * documents, n).otherwise(owner)
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.col("df") + 1))).cast("bigint")
    weighted = asked.join(spread, "term").select("bundle", "slot", "term", weight.alias("weight"), owner.alias("owner"))
    later = F.array(*[F.coalesce(F.sum(F.when(F.col("owner") > n, F.col("weight"))), F.lit(0)) for n in range(len(OWNERS) + 1)])
    rest = weighted.groupBy("bundle", "slot").agg(later.alias("later")).groupBy("bundle")
    rest = rest.agg(F.map_from_entries(F.collect_list(F.struct("slot", "later"))).alias("by_slot"))
    none = F.array_repeat(F.lit(0).cast("bigint"), len(OWNERS) + 1)
    rest = rest.select(
        "bundle", F.transform(F.sequence(F.lit(0), F.lit(BUNDLE - 1)), lambda s: F.coalesce(F.try_element_at("by_slot", s), none)).alias("rest")
    )
    wants = weighted.groupBy("bundle", "term", "weight", "owner").agg(F.collect_list("slot").alias("slots"))
    routed = cut_lineage(postings.join(wants, "term").select("bundle", "block", "owner", "weight", "slots", "docs", "times"))

    state = routed.select("bundle", "block").distinct().join(blocks, "block").join(rest, "bundle")
    state = state.select(
        "bundle", "block", "ids", "sizes", "rest", F.array().cast("array<int>").alias("places"), F.array().cast("array<long>").alias("scores")
    )
    for n in range(len(OWNERS) + 1):
        last = n == len(OWNERS)
        owned = routed.where(F.col("owner") == n).select(
            F.col("bundle").alias("for"), F.col("block").alias("of"), "weight", "slots", "docs", "times"
        )
        state = (
            state.groupBy("bundle", "block")
            .cogroup(owned.groupBy("for", "of"))
            .applyInArrow(_stage(n, documents, max(1, terms), best, last), _FOUND if last else _STATE)
        )
    line = Window.partitionBy("bundle", "slot").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = state.select("*", F.row_number().over(line).alias("rank")).where(F.col("rank") <= best)
    named = asked.select("bundle", "slot", F.col("item").alias("item_id")).distinct()
    return ranked.join(named, ["bundle", "slot"]).select("item_id", "rank", "doc_id", "score")
