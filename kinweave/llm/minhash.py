"""Near copies by b-bit MinHash.

Documents with one shingle set are one class. For each class ``MINIMA`` minima of its hashed shingles
are taken; runs of ``ROWS`` whole minima are the keys of the bands, and of each minimum only the two
low bits are kept, packed into 64-bit words. Classes that share a band key are candidates. Unrelated
minima agree in two bits by chance in a quarter of the cases, so the similarity of a candidate pair is
estimated as (agreeing share - 1/4) / (3/4) by counting bits; pairs that may reach the threshold are
confirmed on their full sets.

A band key that many classes share does not become all its pairs. First each class is compared with two
classes of its key only (the smallest id and the smallest hash). Connected classes need no further
comparing among themselves; for the rest, the classes under a key are cut into blocks, and pairs of
blocks are compared in arrays: estimated, then confirmed on their full sets, where only links that join
different components come out. So none of these is lost, and pairs never become rows.

A pair at the threshold of 0.8 shares no band with probability (1 - 0.8 ** 5) ** 32 = 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import coded_words, hashes, mixed, slices
from kinweave.llm.components import components
from kinweave.session import cut_lineage

BANDS = 32
ROWS = 5
MINIMA = BANDS * ROWS
BITS = 2
#: 64-bit words of a packed signature: 32 lanes of two bits in each.
PACKED = MINIMA * BITS // 64
LANES = 0x5555555555555555
#: Pairs estimated at this much below the threshold are still confirmed (four standard deviations).
SLACK = 0.15
BLOCK = 128

_RNG = np.random.default_rng(6)
_FLIP = _RNG.integers(0, 2**32, MINIMA, dtype=np.uint32)
_ODD = _RNG.integers(0, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _shingles(hashed: np.ndarray, bounds: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """For each text, from the hashes of all words, the hashes of its distinct shingles of ``words`` words; a
    shorter text is one shingle."""
    flat = np.full(max(0, len(hashed) - words + 1), words, dtype=np.uint64)
    for k in range(words):
        flat = mixed(flat * _STEP + hashed[k : k + len(flat)])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(flat[a : b - words + 1])
        elif b > a:
            one = np.full(1, b - a, dtype=np.uint64)
            for k in range(a, b):
                one = mixed(one * _STEP + hashed[k])
            yield one
        else:
            yield flat[:0]


def _signature(shingles: np.ndarray) -> np.ndarray:
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(MINIMA, 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(high), 256):
        low = np.minimum(low, ((high[at : at + 256, None] ^ _FLIP) * _ODD).min(axis=0))
    return low.astype(np.uint64)


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = (np.arange(32, dtype=np.uint64) * np.uint64(BITS))[None, :]
        for batch in slices(batches, 1):
            codes, bounds, distinct = coded_words(batch.column(1))
            hashed = hashes(distinct)[codes]
            sizes, ids, keys, packed = [], [], [], []
            for own in _shingles(hashed, bounds, words):
                sizes.append(len(own))
                if len(own) == 0:
                    ids.append(None), keys.append(None), packed.append(None)
                    continue
                ids.append(int(mixed(own.sum(dtype=np.uint64) + own[:1] * _STEP).view(np.int64)[0]))
                low = _signature(own)
                band = np.arange(BANDS, dtype=np.uint64)
                for column in low.reshape(BANDS, ROWS).T:
                    band = mixed(band * _STEP + column)
                keys.append(band.view(np.int64))
                lanes = mixed(low) & np.uint64((1 << BITS) - 1)
                packed.append(np.bitwise_or.reduce(lanes.reshape(PACKED, 32) << shift, axis=1).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(sizes, pa.int64()),
                    pa.array(ids, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(packed, pa.list_(pa.int64())),
                ],
                names=["doc_id", "version", "n_shingles", "cls", "bands", "low"],
            )

    return run


def sketches(docs: DataFrame, words: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row: doc_id, version (a hash of the text), n_shingles, cls (a hash of the whole set; null
    without shingles), band keys and packed low bits."""
    return _sources(docs, doc, text).mapInArrow(
        _sketch(words), "doc_id bigint, version bigint, n_shingles bigint, cls bigint, bands array<bigint>, low array<bigint>"
    )


def _sources(docs: DataFrame, doc: str, text: str) -> DataFrame:
    plain = F.col(text).cast("string")
    return docs.select(F.col(doc).cast("bigint").alias("doc_id"), plain.alias("text"), F.xxhash64(plain).alias("version"))


def estimate(a: Column, b: Column) -> Column:
    """The collision-corrected similarity of two packed signatures."""

    def apart(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(LANES)))

    unequal = sum((apart(a[k], b[k]) for k in range(1, PACKED)), apart(a[0], b[0]))
    return (1 - unequal / MINIMA - 0.25) / 0.75


def _confirm(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, 2), 3):
            codes, bounds, distinct = coded_words(pa.concat_arrays([batch.column(2), batch.column(3)]))
            n, keep = batch.num_rows, []
            for k in range(n):
                left, right = (set(_tuples(codes[bounds[i] : bounds[i + 1]], words)) for i in (k, n + k))
                both = len(left & right)
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    return run


def _tuples(codes: np.ndarray, words: int) -> list:
    size = min(words, len(codes))
    listed = codes.tolist()
    return list(zip(*[listed[k : len(listed) - size + 1 + k] for k in range(size)], strict=True))


def _confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the candidate pairs (a, b) those whose sets are similar enough."""
    side = classes.select("cls", "n_shingles", "low")
    known = pairs.join(side.select(F.col("cls").alias("a"), F.col("n_shingles").alias("n_a"), F.col("low").alias("low_a")), "a").join(
        side.select(F.col("cls").alias("b"), F.col("n_shingles").alias("n_b"), F.col("low").alias("low_b")), "b"
    )
    likely = cut_lineage(
        known.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        .where(estimate(F.col("low_a"), F.col("low_b")) >= percent / 100 - SLACK)
        .select("a", "b")
    )
    wanted = likely.select(F.col("a").alias("cls")).union(likely.select(F.col("b").alias("cls"))).distinct()
    own = cut_lineage(texts.join(wanted, "cls", "left_semi"))
    full = likely.join(own.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a").join(
        own.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b"
    )
    return cut_lineage(full.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(words, percent), "a bigint, b bigint"))


def _apart(words: int, percent: int):
    """Links between different components in two blocks of one band key, confirmed on the full sets; of
    those that join the same components the first."""

    def common(texts: list[str], n: int) -> np.ndarray:
        """How many shingles each of the first n texts shares with each of the others."""
        codes, bounds, distinct = coded_words(pa.array(texts, pa.string()))
        own = list(_shingles(hashes(distinct)[codes], bounds, words))
        sides = [(np.concatenate(part), np.repeat(np.arange(len(part)), [len(x) for x in part])) for part in (own[:n], own[n:])]
        shared = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]))
        out = np.zeros((n, len(texts) - n), dtype=np.float32)
        for at in range(0, len(shared), 8192):
            columns = shared[at : at + 8192]
            tables = []
            for (flat, row), size in zip(sides, out.shape, strict=True):
                spot = np.minimum(np.searchsorted(columns, flat), len(columns) - 1)
                hit = columns[spot] == flat
                table = np.zeros((size, len(columns)), dtype=np.float32)
                table[row[hit], spot[hit]] = 1
                tables.append(table)
            out += tables[0] @ tables[1].T
        return out.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                left, right = row["left"], row["right"]
                comp_l, comp_r = (np.array([x["component"] for x in side]) for side in (left, right))
                n_l, n_r = (np.array([x["n_shingles"] for x in side]) for side in (left, right))
                low_l, low_r = (np.array([x["low"] for x in side], dtype=np.int64).view(np.uint64) for side in (left, right))
                unequal = np.zeros((len(left), len(right)), dtype=np.int32)
                for k in range(PACKED):
                    z = low_l[:, k, None] ^ low_r[None, :, k]
                    unequal += np.bitwise_count((z | (z >> np.uint64(1))) & np.uint64(LANES))
                guess = (1 - unequal / MINIMA - 0.25) / 0.75
                like = (guess >= percent / 100 - SLACK) & (comp_l[:, None] != comp_r[None, :])
                like &= 100 * np.minimum(n_l[:, None], n_r) >= percent * np.maximum(n_l[:, None], n_r)
                if row["same"]:
                    like = np.triu(like, 1)
                if not like.any():
                    continue
                both = common([x["text"] for x in left + right], len(left))
                like &= 100 * both >= percent * (n_l[:, None] + n_r - both)
                root: dict[int, int] = {}

                def top(c: int, root: dict[int, int] = root) -> int:
                    while root.get(c, c) != c:
                        c = root[c]
                    return c

                out = []
                for x, y in zip(*[k.tolist() for k in np.nonzero(like)], strict=True):
                    a, b = top(left[x]["component"]), top(right[y]["component"])
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        out.append((left[x]["cls"], right[y]["cls"]))
                yield pa.RecordBatch.from_pydict({"a": pa.array([min(p) for p in out], pa.int64()), "b": pa.array([max(p) for p in out], pa.int64())})

    return run


def _leftover(shared: DataFrame, classes: DataFrame, texts: DataFrame, component: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between components that the first comparisons have left apart.

    Under a key, classes of the component with most classes there need no comparing among themselves: the
    others, usually few, are compared with them and with each other, block by block.
    """
    members = shared.where("n > 2").select("cls", "key").join(component.select(F.col("node").alias("cls"), "component"), "cls")
    parts = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    keys = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("m"), F.count("*").alias("parts"), F.sum("n").alias("n"))
    keys = keys.where("parts > 1").select("key", "n", F.col("m.component").alias("main"))
    open_ = members.join(keys, "key").join(classes.select("cls", "n_shingles", "low").join(texts, "cls"), "cls")
    block = F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / BLOCK)).cast("int")
    blocks = cut_lineage(
        open_.select("key", (F.col("component") != F.col("main")).alias("rest"), block.alias("block"), F.struct("cls", "component", "n_shingles", "low", "text").alias("row"))
        .groupBy("key", "rest", "block")
        .agg(F.collect_list("row").alias("rows"))
    )  # a block has about BLOCK rows
    left = blocks.where("rest").select("key", F.col("block").alias("i"), F.col("rows").alias("left"))
    right = blocks.select("key", "rest", F.col("block").alias("j"), F.col("rows").alias("right"))
    same = F.col("rest") & (F.col("i") == F.col("j"))
    pairs = left.join(right, "key").where("not rest or i <= j").select("left", "right", same.alias("same"))
    return pairs.mapInArrow(_apart(words, percent), "a bigint, b bigint").distinct()


def near_copies(docs: DataFrame, words: int = 5, percent: int = 80, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable by
    links of at least ``percent`` similarity) and kept (doc_id is that one).

    Words are runs between ASCII white space, A-Z in lower case; a text of fewer words than a shingle is
    one shingle. Null and blank texts have no shingles and are linked with nothing: their component is
    their own id. Repeated texts are one class, and so are repeated rows. A null id is larger than any
    other: it names a component of such rows only.
    """
    return grouped(docs, words, percent, doc, text).select("doc_id", "n_shingles", "component_id", "kept")


def grouped(docs: DataFrame, words: int = 5, percent: int = 80, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``near_copies`` with version, a hash of the text, and component, a number of the linked
    texts: unlike ids it tells unlinked texts with one id apart. It is null without shingles."""
    rows = cut_lineage(sketches(docs, words, doc, text))
    full = rows.where("cls is not null")
    first = full.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "version", "n_shingles", "bands", "low")).alias("m"))
    classes = cut_lineage(first.select("cls", *[f"m.{c}" for c in ("doc_id", "version", "n_shingles", "bands", "low")]))
    keyed = classes.select("cls", F.explode("bands").alias("key"))
    spans = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("cls").alias("first"), F.max("cls").alias("last")).where("n > 1")
    shared = cut_lineage(keyed.join(spans, "key"))
    stars = shared.select("cls", F.explode(F.array("first", "last")).alias("x")).where("x <> cls")
    pairs = stars.select(F.least("cls", "x").alias("a"), F.greatest("cls", "x").alias("b")).distinct()
    wanted = classes.select("cls", "doc_id", "version").join(shared.select("cls").distinct(), "cls", "left_semi")
    ids = wanted.select("cls", F.col("doc_id").alias("id"), F.col("version").alias("v"))
    sources = _sources(docs, doc, text).join(ids, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("version") == F.col("v")))
    texts = cut_lineage(sources.select("cls", "text").dropDuplicates(["cls"]))
    links = _confirmed(pairs, classes, texts, words, percent)
    near = components(links)
    everyone = classes.select(F.col("cls").alias("node")).join(near, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    more = cut_lineage(_leftover(shared, classes, texts, cut_lineage(everyone), words, percent))
    if not more.isEmpty():
        near = components(links.union(more))
    joined = classes.select("cls", "doc_id").join(near, F.col("cls") == F.col("node"), "left").select("cls", "doc_id", F.coalesce("component", "cls").alias("component"))
    least = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = joined.join(least, "component").select("cls", "component_id", "component")
    columns = ["doc_id", "version", "n_shingles", "component_id", "component"]
    out = full.select("doc_id", "version", "n_shingles", "cls").join(named, "cls", "left").select(columns)
    alone = rows.where("cls is null").withColumns({"component_id": F.col("doc_id"), "component": F.lit(None).cast("bigint")}).select(columns)
    return out.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
