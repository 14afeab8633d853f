"""Top-k retrieval: recency, company and vector search, for one question or a table of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.functions.words import all_words, stems_of
from kinweave.operators.dedupe import top_per
from kinweave.operators.governance import live_interactions, live_people
from kinweave.operators.skew import salted_join
from kinweave.session import cut_lineage, spread_if_small

# Rows per answer, the cosine floor, the longest page, the timeline length.
TOP_K = 8
MIN_SCORE = 0.05
MAX_PAGE = 200
RECENT_PER_PERSON = 20
# Questions scored in one pass over the chunks; more of them take more passes.
QUESTIONS_PER_PASS = 16_384
# Scores held at once by a task.
CELLS_PER_PIECE = 4_000_000
# One chunk in so many, from all over, stands before the others and gives the questions their first floors.
AHEAD = 16
# Bytes of text that a task cuts into words at once, and how many texts and distinct stems of texts are packed together.
TEXT_AT_ONCE = 32_000_000
PACKED, STEMS_PACKED = 1024, 1_000_000
# A stem with more than this share of a piece's pairs of chunk and question is multiplied as a dense column, the
# others by their lists: about what a list's entry costs next to a column's.
DENSE_SHARE = 0.002


def recency_order() -> list:
    """Newest first, unknown times last; the record's key settles ties."""
    return [F.col("occurred_at").desc_nulls_last(), F.col("source_type").asc(), F.col("source_record_id").asc()]


def people_page(people: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of the live people by name. A top-(offset + limit) on every task, then a merge."""
    page = live_people(people).orderBy(F.col("display_name").asc_nulls_last(), F.col("id").asc())
    return page.offset(offset).limit(min(limit, MAX_PAGE)) if offset else page.limit(min(limit, MAX_PAGE))


def recent_per_person(people: DataFrame, interactions: DataFrame, n: int = RECENT_PER_PERSON) -> DataFrame:
    """The ``n`` latest live interactions of every person, ranked."""
    ranked = top_per(live_interactions(interactions), ["tenant_id", "person_id"], recency_order(), n, rank="place")
    return ranked.join(
        people.select("tenant_id", F.col("id").alias("person_id"), "display_name"), ["tenant_id", "person_id"]
    )


def interactions_with_people(interactions: DataFrame, people: DataFrame) -> DataFrame:
    """Live interactions of live people with the person's name, company and address."""
    who = live_people(people).select(
        "tenant_id", F.col("id").alias("person_id"), "display_name", "company", "primary_email"
    )
    return live_interactions(interactions).join(who, ["tenant_id", "person_id"])


def contains_matches(slots: DataFrame, values: DataFrame, slot: str, value: str) -> DataFrame:
    """(tenant_id, slot, value) where the value contains the slot, ignoring case.

    Both inputs are distinct. Every run of three characters of a contained slot is a run of the
    value, so this is an equi-join on the slot's rarest run plus the test itself, not a comparison
    of everything with everything.
    """
    size = 3

    def runs(text: Column, n: int) -> Column:
        return F.when(
            F.length(text) >= n,
            F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))),
        ).otherwise(F.array().cast("array<string>"))

    low_value, low_slot = F.lower(F.col(value)), F.lower(F.col(slot))
    every_run = F.array_distinct(F.flatten(F.array(*[runs(low_value, n) for n in range(1, size + 1)])))
    keyed_values = values.withColumn("_run", F.explode(every_run))
    own_runs = F.when(F.length(low_slot) < size, F.array(low_slot)).otherwise(F.array_distinct(runs(low_slot, size)))
    slot_runs = slots.where(F.col(slot) != "").withColumn("_run", F.explode(own_runs))
    frequency = keyed_values.groupBy("tenant_id", "_run").agg(F.count("*").alias("_n"))
    # A run no value has proves that nothing matches; NULL sorts first and then joins nothing.
    rarest = top_per(
        slot_runs.join(frequency, ["tenant_id", "_run"], "left"),
        ["tenant_id", slot],
        [F.col("_n").asc_nulls_first(), F.col("_run").asc()],
    ).drop("_n")
    return (
        salted_join(keyed_values, rarest, ["tenant_id", "_run"], value)
        .where(F.contains(low_value, low_slot))
        .select("tenant_id", slot, value)
    )


# ---- vector search -----------------------------------------------------------------------------


class _Best:
    """The k best (score, chunk) per question seen by one task; ties go to the smaller chunk id.

    ``floor`` is at most the k-th best score of every question so far: almost all later scores fall below
    it and are dropped by one array comparison.
    """

    def __init__(self, k: int, questions: int) -> None:
        self.k = k
        self.floor = np.full(questions, -np.inf)
        self.parts: list[pd.DataFrame] = []
        self.held = 0
        self.room = 4 * k * questions + 100_000

    def offer(self, scores: np.ndarray, exact: Callable | None, columns: np.ndarray | None, slack: float, ids: np.ndarray) -> None:
        """``scores`` is chunks x questions with NaN where a pair does not count; with ``columns`` of these
        questions only, as no chunk here reaches the floor of another. With ``exact`` (rows, columns, scores ->
        scores) they are within ``slack`` of the exact ones, which are then taken."""
        n = scores.shape[0]
        if n > self.k and self.floor.max(initial=-np.inf) == -np.inf:
            best = np.partition(np.where(np.isnan(scores), -np.inf, scores), n - self.k, axis=0)[n - self.k]
            self.floor = np.maximum(self.floor, best.astype(np.float64) - slack)
        floor = self.floor if columns is None else self.floor[columns]
        place = np.flatnonzero(scores >= (floor - slack).astype(scores.dtype)[None, :])
        row, question = np.divmod(place, scores.shape[1])
        score = scores.reshape(-1)[place]
        score = exact(row, question, score) if exact else score
        good = score >= floor[question]
        if good.any():
            row, question, score = row[good], question[good], score[good]
            question = question if columns is None else columns[question]
            self.parts.append(pd.DataFrame({"question": question, "score": score, "chunk_id": ids[row]}))
            self.held += row.size
        if self.held > self.room:
            self.prune()

    def prune(self) -> pd.DataFrame | None:
        if not self.parts:
            return None
        rows = pd.concat(self.parts, ignore_index=True)
        rows = rows.sort_values(["question", "score", "chunk_id"], ascending=[True, False, True])
        rows = rows[rows.groupby("question").cumcount() < self.k]
        full = rows.groupby("question")["score"].agg(["size", "min"])
        full = full[full["size"] == self.k]
        self.floor[full.index.to_numpy()] = full["min"].to_numpy()
        self.parts, self.held = [rows], len(rows)
        return rows


def _search(
    chunks: DataFrame,
    questions: DataFrame,
    k: int,
    chunk_columns: list[str],
    question_columns: list[str],
    prepare: Callable,
    packed: bool = False,
) -> DataFrame:
    """Exact top-k per question without a join of all pairs.

    ``prepare`` turns one tenant's questions of a block into a scorer of Arrow batches; a tenant's chunks
    meet that tenant's questions only. Every task keeps k rows per question while it reads its chunks, so
    only tasks * questions * k rows are shuffled, whatever the number of chunks. A block has a bounded
    number of questions; a larger table is answered in several passes, each written before the next one, so
    the driver holds one block. ``packed`` chunks come from ``_bags``.
    """
    out_schema = T.StructType(
        [
            T.StructField("qid", questions.schema["qid"].dataType),
            T.StructField("chunk_id", chunks.schema["chunk_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    source = chunks.select("tenant_id", *([] if packed else ["chunk_id"]), *chunk_columns)
    by_tenant = _unpacked if packed else _by_tenant
    asked = cut_lineage(questions.select("tenant_id", "qid", *question_columns))
    passes = -(-asked.count() // QUESTIONS_PER_PASS) or 1
    found = None
    for i in range(passes):
        block = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == i)
        block_rows = block.toArrow()
        places: dict = {}
        for place, tenant in enumerate(block_rows.column("tenant_id").to_pylist()):
            places.setdefault(tenant, []).append(place)

        def task(batches: Iterator[pa.RecordBatch], rows=block_rows, places=places):
            id_type, own = None, {}
            for batch in batches:
                for tenant, mine in by_tenant(batch, places):
                    id_type = mine.schema.field("chunk_id").type
                    if tenant not in own:
                        part = rows.take(places[tenant]).combine_chunks()
                        own[tenant] = (prepare(part), _Best(k, part.num_rows), part.column("qid").to_pylist())
                    score, best, _ = own[tenant]
                    step = min(1024, max(k + 1, CELLS_PER_PIECE // len(best.floor)))
                    for start in range(0, mine.num_rows, step):
                        piece = mine.slice(start, step)
                        best.offer(*score(piece, best.floor), piece.column("chunk_id").to_numpy(zero_copy_only=False))
            for _, best, qids in own.values():
                hits = best.prune()
                if hits is not None:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([qids[q] for q in hits["question"]]),
                            pa.array(hits["chunk_id"].tolist(), id_type),
                            pa.array(hits["score"].to_numpy(), pa.float64()),
                        ],
                        names=["qid", "chunk_id", "score"],
                    )

        part = source.mapInArrow(task, out_schema)
        part = part if passes == 1 else cut_lineage(part)
        found = part if found is None else found.unionByName(part)
    return top_per(found, ["qid"], [F.col("score").desc(), F.col("chunk_id").asc()], k, rank="place")


def _by_tenant(batch: pa.RecordBatch, tenants: dict) -> Iterator[tuple]:
    """The rows of each of the ``tenants`` in a batch."""
    at: dict = {}
    for row, tenant in enumerate(batch.column("tenant_id").to_pylist()):
        at.setdefault(tenant, []).append(row)
    for tenant, mine in at.items():
        if tenant in tenants:
            yield tenant, batch.take(pa.array(mine))


def _unpacked(batch: pa.RecordBatch, tenants: dict) -> Iterator[tuple]:
    """As ``_by_tenant``, of what ``_bags`` packed."""
    for row, tenant in enumerate(batch.column("tenant_id").to_pylist()):
        if tenant in tenants:
            with pa.ipc.open_stream(batch.column("bags")[row].as_buffer()) as stream:
                yield tenant, stream.read_next_batch()


def vector_topk(chunks: DataFrame, questions: DataFrame, k: int = TOP_K) -> DataFrame:
    """(qid, chunk_id, score, place): the k nearest chunks of the question's tenant by cosine.

    ``chunks`` is (tenant_id, chunk_id, embedding), already restricted to live people;
    ``questions`` is (tenant_id, qid, embedding). Zero vectors have no cosine and never match, nor do
    vectors of different lengths, or missing ones.
    """

    def prepare(block: pa.Table) -> Callable:
        widths = pc.list_value_length(block.column("embedding")).fill_null(0).to_numpy()
        asked = {
            w: np.array(block.column("embedding").take(pa.array(np.flatnonzero(widths == w))).to_pylist(), dtype=np.float64)
            for w in np.unique(widths)
            if w
        }

        def score(batch: pa.RecordBatch, floor: np.ndarray) -> tuple:
            column = batch.column("embedding")
            own_widths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
            out = np.full((batch.num_rows, block.num_rows), np.nan)
            for width, vectors in asked.items():
                rows = np.flatnonzero(own_widths == width)
                if not rows.size:
                    continue
                matrix = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
                matrix = matrix.astype(np.float64).reshape(-1, width)
                lengths = [np.sqrt((m * m).sum(axis=1)) for m in (matrix, vectors)]
                with np.errstate(invalid="ignore", divide="ignore"):
                    cosine = (matrix @ vectors.T) / (lengths[0][:, None] * lengths[1][None, :])
                out[np.ix_(rows, np.flatnonzero(widths == width))] = cosine
            return out, None, None, 0.0

        return score

    usable = spread_if_small(chunks.where(F.col("embedding").isNotNull()))
    return _search(usable, questions, k, ["embedding"], ["embedding"], prepare)


def vector_topk_approximate(
    chunks: DataFrame, questions: DataFrame, k: int = TOP_K, tables: int = 12, bits: int = 8, seed: int = 1
) -> DataFrame:
    """As ``vector_topk``, looking only at chunks that fall on the question's side of ``bits`` random
    planes in one of ``tables`` draws. Approximate by its nature; measure it with ``mean_recall``.

    All vectors have the length of the longest question's; others never match.
    A lookup is an equi-join on (tenant, table, bucket). A bucket that holds a large part of the
    chunks is salted, so no task scores more than a bounded number of pairs.
    """
    dim = questions.agg(F.max(F.size("embedding"))).head()[0] or 1
    chunks, questions = (df.where(F.size("embedding") == dim) for df in (chunks, questions))
    planes = np.random.default_rng(seed).normal(size=(dim, tables * bits))
    weights = 1 << np.arange(bits)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def buckets(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype=object)
        side = (np.stack(vectors.to_numpy()).astype(np.float64) @ planes) > 0
        codes = side.reshape(len(vectors), tables, bits) @ weights + (np.arange(tables) << bits)
        return pd.Series(list(codes.astype(np.int64)), index=vectors.index)

    @F.pandas_udf(T.DoubleType())
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        if a.empty:
            return pd.Series([], dtype="float64")
        x, y = (np.stack(v.to_numpy()).astype(np.float64) for v in (a, b))
        with np.errstate(invalid="ignore", divide="ignore"):
            out = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
        return pd.Series(out).where(~np.isnan(out), None)

    placed = chunks.where(F.col("embedding").isNotNull()).select(
        "tenant_id", "chunk_id", "embedding", F.explode(buckets("embedding")).alias("bucket")
    )
    asked = questions.select(
        "tenant_id", "qid", F.col("embedding").alias("asked"), F.explode(buckets("embedding")).alias("bucket")
    )
    met = salted_join(placed, asked, ["tenant_id", "bucket"], "chunk_id")
    scored = met.withColumn("score", cosine("embedding", "asked")).where("score is not null")
    once = scored.groupBy("qid", "chunk_id").agg(F.max("score").alias("score"))
    return top_per(once, ["qid"], [F.col("score").desc(), F.col("chunk_id").asc()], k, rank="place")


def words_topk(chunks: DataFrame, questions: DataFrame, k: int = TOP_K) -> DataFrame:
    """As ``vector_topk`` with stemmed bags of words: one dimension per distinct stem.

    ``chunks`` has ``chunk_text`` and ``questions`` has ``question``; whole texts are scored. score = dot / sqrt(|q|^2 |c|^2), with whole-number counts. A tenant's questions
    of equal stems are searched once, and their hits are joined to each of them. Missing texts have no stems.
    """
    words = questions.select("tenant_id", "qid", F.col("question").alias("text"))
    worded = cut_lineage(_stemmed(words, "qid").select("tenant_id", "qid", "stems"))
    once = worded.groupBy("tenant_id", "stems").agg(F.min("qid").alias("_first"))
    member = worded.alias("w").join(
        once.alias("o"), F.col("w.tenant_id").eqNullSafe(F.col("o.tenant_id")) & (F.col("w.stems") == F.col("o.stems"))
    ).select(F.col("w.qid").alias("qid"), "_first")

    def prepare(block: pa.Table) -> Callable:
        asked = block.num_rows
        flat = block.column("stems").combine_chunks()
        codes = flat.flatten().dictionary_encode()
        vocabulary, size = codes.dictionary, len(codes.dictionary)
        owner = np.repeat(np.arange(asked), pc.list_value_length(flat).to_numpy(zero_copy_only=False))
        # One cell per stem and question, by stem: the questions of a stem are a run.
        cells, weights = np.unique(codes.indices.to_numpy(zero_copy_only=False).astype(np.int64) * asked + owner, return_counts=True)
        all_stems, all_questions = cells // asked, cells % asked
        squares = np.bincount(all_questions, weights=weights.astype(np.float64) ** 2, minlength=asked)
        lengths = np.sqrt(squares)
        all_shares = weights / lengths[all_questions]
        everyone = np.arange(asked)

        def score(batch: pa.RecordBatch, floor: np.ndarray) -> tuple:
            column, n = batch.column("stems"), batch.num_rows
            at = np.repeat(np.arange(n), pc.list_value_length(column).to_numpy(zero_copy_only=False))
            count = batch.column("counts").flatten().to_numpy(zero_copy_only=False)
            flat = column.flatten()
            term = pc.index_in(flat.dictionary, vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)[flat.indices.to_numpy(zero_copy_only=False)]
            known = term >= 0
            at, count, term = at[known], count[known].astype(np.float64), term[known].astype(np.int64)
            own = batch.column("own").to_numpy(zero_copy_only=False).astype(np.float64)
            norms = np.sqrt(own)
            share = count / norms[at]
            held = np.bincount(term, minlength=size)
            # No chunk here is nearer to a question than one would be that had the largest share of every stem.
            largest = np.zeros(size)
            np.maximum.at(largest, term, share)
            near = np.bincount(all_questions, weights=all_shares * largest[all_stems], minlength=asked)
            columns = np.flatnonzero(near + 1e-6 >= floor)
            if columns.size > 0.9 * asked:
                columns = everyone
            place = np.full(asked, -1)
            place[columns] = np.arange(columns.size)
            mine = (place[all_questions] >= 0) & (held[all_stems] > 0)
            stem, question, part = all_stems[mine], place[all_questions[mine]], all_shares[mine]
            lists = np.bincount(stem, minlength=size)
            starts = np.cumsum(lists) - lists
            weight = lists * held
            often = weight > DENSE_SHARE * n * columns.size
            room = CELLS_PER_PIECE // max(n, columns.size, 1) + 1
            if often.sum() > room:
                often &= weight >= np.partition(weight, size - room)[size - room]
                often &= np.cumsum(often) <= 2 * room
            # The sum of up to so many products of shares of lengths is this near to the exact one; where that does
            # not settle the whole number behind it, double precision does.
            longest = int(often.sum()) + int(np.bincount(question, minlength=1).max(initial=0)) + 8
            slack = longest * 2.0**-23
            single = slack * norms.max(initial=0) * lengths.max(initial=0) < 0.4
            kind, slack = (np.float32, slack) if single else (np.float64, longest * 2.0**-52)
            row_of = np.cumsum(often) - 1
            dense = np.zeros((int(often.sum()), columns.size), dtype=kind)
            thick = often[stem]
            dense[row_of[stem[thick]], question[thick]] = part[thick]
            table = np.zeros((n, dense.shape[0]), dtype=kind)
            thick = often[term]
            table[at[thick], row_of[term[thick]]] = share[thick]
            dots = table @ dense
            at, term, share = at[~thick], term[~thick], share[~thick].astype(kind)
            runs = lists[term]
            part, total = part.astype(kind), np.cumsum(runs)
            for start, end in zip(*_runs(total // CELLS_PER_PIECE)):
                few, before = runs[start:end], total[start:end] - runs[start:end]
                inside = np.arange(few.sum()) - np.repeat(before - before[0] - starts[term[start:end]], few)
                cell = np.repeat(at[start:end] * columns.size, few)
                cell += question[inside]
                np.add.at(dots.reshape(-1), cell, np.repeat(share[start:end], few) * part[inside])
            if not own.all():
                dots[own == 0] = np.nan
            wordless = squares[columns] == 0
            if wordless.any():
                dots[:, wordless] = np.nan

            def exact(rows: np.ndarray, places: np.ndarray, quick: np.ndarray) -> np.ndarray:
                asked_squares = squares[columns[places]]
                dot = np.rint(quick.astype(np.float64) * norms[rows] * np.sqrt(asked_squares))
                return dot / np.sqrt(own[rows] * asked_squares)

            return dots, exact, None if columns is everyone else columns, slack

        return score

    bags = cut_lineage(_bags(spread_if_small(chunks).select("tenant_id", "chunk_id", F.col("chunk_text").alias("text"))))
    hits = _search(
        bags.withColumn("chunk_id", F.lit(None).cast(chunks.schema["chunk_id"].dataType)),
        once.select("tenant_id", F.col("_first").alias("qid"), "stems"),
        k,
        ["bags"],
        ["stems"],
        prepare,
        packed=True,
    )
    return hits.withColumnRenamed("qid", "_first").join(member, "_first").select("qid", "chunk_id", "score", "place")


def _stemmed(texts: DataFrame, key: str) -> DataFrame:
    """(tenant_id, key, stems): a text's stems in order of the alphabet, repeats kept; none for a missing text."""
    schema = T.StructType([texts.schema["tenant_id"], texts.schema[key], T.StructField("stems", T.ArrayType(T.StringType()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ends = all_words(batch.column("text").to_pylist())
            coded = words.dictionary_encode()
            known, code = np.unique(np.array(stems_of(coded.dictionary.to_pylist()), dtype=object), return_inverse=True)
            code = code[coded.indices.to_numpy(zero_copy_only=False)]
            code = code[np.lexsort((code, np.repeat(np.arange(batch.num_rows), np.diff(ends))))]
            stems = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(known, pa.string()).take(pa.array(code)))
            yield pa.RecordBatch.from_arrays([batch.column("tenant_id"), batch.column(key), stems], names=["tenant_id", key, "stems"])

    return texts.mapInArrow(task, schema)


def _bags(texts: DataFrame) -> DataFrame:
    """(tenant_id, bags): up to ``PACKED`` texts of a tenant as one Arrow stream of (chunk_id, own, stems,
    counts): the sum of the squares of all counts, the distinct stems and how often each comes. A list of strings
    per text would take longer to read than to search. Texts with one most frequent stem stand together, so that a
    piece has few stems and meets few questions.
    """
    schema = T.StructType(
        [
            texts.schema["tenant_id"],
            T.StructField("bags", T.BinaryType()),
        ]
    )

    def packed(tenants: pa.Array, ids: pa.Array, texts: list[str | None]) -> Iterator[tuple]:
        words, ends = all_words(texts)
        n, coded = len(texts), words.dictionary_encode()
        stems = pa.array(stems_of(coded.dictionary.to_pylist()), pa.string()).dictionary_encode()
        code = stems.indices.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
        size = max(1, len(stems.dictionary))
        cells, counts = np.unique(np.repeat(np.arange(n), np.diff(ends)) * size + code, return_counts=True)
        owner, code = cells // size, cells % size
        each = np.bincount(owner, minlength=n)
        starts = np.cumsum(each) - each
        own = np.bincount(owner, weights=counts.astype(np.float64) ** 2, minlength=n).astype(np.int64)
        main = np.full(n, -1)
        main[each > 0] = code[np.lexsort((code, -counts, owner))[starts[each > 0]]]
        names = tenants.dictionary_encode()
        tenant = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        for name in np.unique(tenant):
            rows = np.flatnonzero(tenant == name)
            rows = rows[np.argsort(main[rows], kind="stable")]
            for mine in (rows[::AHEAD], np.delete(rows, np.s_[::AHEAD])):
                groups = np.maximum(np.cumsum(each[mine]) // STEMS_PACKED, np.arange(mine.size) // PACKED)
                for start, end in zip(*_runs(groups)):
                    some = mine[start:end]
                    limits = np.concatenate([[0], np.cumsum(each[some])])
                    inside = np.arange(limits[-1]) + np.repeat(starts[some] - limits[:-1], each[some])
                    used, short = np.unique(code[inside], return_inverse=True)
                    flat = pa.DictionaryArray.from_arrays(pa.array(short.astype(np.int32)), stems.dictionary.take(pa.array(used)))
                    limits = pa.array(limits.astype(np.int32))
                    bags = pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(some)),
                            pa.array(own[some]),
                            pa.ListArray.from_arrays(limits, flat),
                            pa.ListArray.from_arrays(limits, pa.array(counts[inside].astype(np.int32))),
                        ],
                        names=["chunk_id", "own", "stems", "counts"],
                    )
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, bags.schema) as stream:
                        stream.write_batch(bags)
                    yield None if name < 0 else names.dictionary[name].as_py(), sink.getvalue().to_pybytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # So many texts at a time that their words do not take much room, but one at least.
            sizes = pc.fill_null(pc.binary_length(whole.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for start, end in zip(*_runs(np.cumsum(sizes) // TEXT_AT_ONCE)):
                batch = whole.slice(start, end - start)
                for row in packed(batch.column("tenant_id"), batch.column("chunk_id"), batch.column("text").to_pylist()):
                    kinds = (batch.schema.field("tenant_id").type, pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds)], names=["tenant_id", "bags"])

    return texts.mapInArrow(task, schema)


def _runs(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal numbers."""
    starts = np.flatnonzero(np.diff(groups, prepend=-1)) if groups.size else np.array([], dtype=np.int64)
    return starts, np.append(starts[1:], groups.size) if groups.size else starts


def above_floor(hits: DataFrame, floor: float = MIN_SCORE) -> DataFrame:
    """The floor counts after the top-k, on the unrounded score."""
    return hits.where(F.col("score") >= floor).withColumn("score", F.round("score", 4))
