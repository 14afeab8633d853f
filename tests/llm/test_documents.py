from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import decontaminate, language, minhash, mixture, pii, pitman_yor, shard_table, token_files
from kinweave.llm.common import SPACED_WORD, coded_words, hashes, slices
from kinweave.session import scratch_path
from tests.llm import plain

SMALL = "/root/testdata/sf0.001"
ODD = [
    (-1, None, None, None, 0),
    (-2, "", "en", "a", 0),
    (-3, " \t\n", "en", "a", 3),
    (-4, "one", "en", None, 3),
    (-5, "One TWO\vtwo", "en", "b", 11),
    (-5, "One TWO\vtwo", "en", "b", 11),
    (None, "One TWO\vtwo", "en", "b", 11),
    (-6, "1234 5678 --", None, "b", 12),
    (-7, "long " * 60_000, "en", "c", 300_000),
    (-8, "mail a@b.c-_x@d.e, é 1.2.3.4.5.6.7.8 000001.2.3.4 4111 1111-1111 1111 +1 (23) 45.67-89 +1 2 1.1.1.300", "en", "c", 90),
]


@pytest.fixture(scope="module")
def docs(spark):
    known = spark.read.parquet(f"{SMALL}/documents.parquet")
    return known.unionByName(spark.createDataFrame(ODD, known.schema)).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def empty(docs):
    return docs.where("false")


def test_words_are_those_of_plain_splitting():
    import pyarrow as pa

    texts = pa.array(["a  B\vc", None, "", " é x\x1cy ", "a"] * 3)
    for part in slices([pa.RecordBatch.from_arrays([texts], names=["t"])], 0, 8):
        codes, bounds, distinct = coded_words(part.column(0))
        got = [[distinct[int(c)].as_py() for c in codes[a:b]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        assert got == [plain.words(t.as_py()) for t in part.column(0)]
    many = pa.array([str(k) for k in range(50_000)] + ["", "a", "aa"])
    assert len(set(hashes(many).tolist())) == 50_003
    assert SPACED_WORD.startswith("[^")


def test_language_learns_from_training_rows_only_and_predicts_held_out(docs):
    out = language.predict(docs)
    got = out.join(docs.select("doc_id", "lang", "text").distinct(), "doc_id").collect()
    assert out.count() == docs.count()
    told = [r for r in got if r.held_out and r.doc_id >= 0 and len(r.text) > 40]
    assert np.mean([r.lang == r.lang_pred for r in told]) > 0.93
    assert {r.lang_pred for r in got if not any(c.isalpha() for c in r.text or "")} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)
    hidden = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.col("lang")))
    assert language.predict(hidden).exceptAll(out).isEmpty()


def test_language_without_rows_or_labels(docs):
    assert language.predict(empty(docs)).isEmpty()
    none = language.predict(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in none] == ["und"]


def test_language_keeps_columns_with_clashing_names(docs):
    wide = docs.withColumn("score", F.lit("own")).withColumn("LANG_PRED", F.lit("own"))
    out, names = language.identify(wide, language.fit(wide))
    assert len(set(c.lower() for c in out.columns)) == len(wide.columns) + 3 and "score" not in names
    assert out.where("score <> 'own'").isEmpty()


def test_tokens_read_back_as_encoded(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_files.write_tokens(docs, scratch_path(spark, "t"), open(path, encoding="utf-8").read(), 1)
    got = [tuple(r) for r in token_files.read_tokens(manifest).orderBy("start").collect()]
    tokenizer, start, want = Tokenizer.from_file(path), 0, []
    seen = defaultdict(list)
    for r in rows:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        seen[r.doc_id].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for doc in sorted(seen, key=lambda i: (i is not None, i or 0)):
        for n, crc in seen[doc]:
            want.append((doc, start, n, crc))
            start += n
    assert got == want
    none = token_files.write_tokens(empty(docs), scratch_path(spark, "t"), open(path, encoding="utf-8").read(), 1)
    assert token_files.read_tokens(none).isEmpty()


def test_pii_odds_outweigh_one_vote(spark):
    """Spelled-out endings are known ones, and one labeler against a span does not rule it out."""
    rows = [(k, f"please mail name{k} (at) host{k} (dot) com today") for k in range(60)]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[k].startswith("email:") for k in range(60))
    # kind email; votes of pattern, gazetteer, context, touch as digits 0 (against) to 2; size 2, apart 0
    code = lambda *votes: (int("".join(map(str, votes)), 3) * 4 + 2) * 3
    assert code(1, 0, 2, 2) in pii.train({code(1, 2, 2, 2): 1000, code(1, 0, 2, 2): 500, code(1, 2, 0, 0): 50, code(1, 0, 0, 0): 1000})


@pytest.mark.parametrize("special", ["<|endoftext|>", "<|startoftext|>"])
def test_special_strings_are_encoded_as_in_whole_texts(special):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [special, f"one {special} two", f"one{special}two", f" {special}\n{special}{special} a", f"é,{special}.\tB {special.upper()}", f"{special} ", f"x\n{special}\u00a0y"]
    got = token_files.Encoder(open(path, encoding="utf-8").read(), "<u2").encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_remembered_pieces_do_not_change_ids(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    vocabulary = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    whole, encoder = Tokenizer.from_str(vocabulary), token_files.worker_encoder(vocabulary, "<u2")
    assert token_files.worker_encoder(vocabulary, "<u2") is encoder
    monkeypatch.setattr(token_files, "MEMORY", 3)
    for n in range(12):
        texts = [f"often  piece{n % 5} rare{n}\nOften", None, "", f" piece{n % 2}."]
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == whole.encode(text or "", add_special_tokens=False).ids
    assert len(encoder.known) + len(encoder.before) < 20


@pytest.mark.parametrize("dtype", ["<u2", "<u4"])
def test_ids_of_pieces_of_any_length_are_packed_alike(dtype):
    import public_tokenizers

    encoder = token_files.Encoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read(), dtype)
    for n in [0, 1, 2, 8, 9, 300]:
        ids = [(k * 7919) % 49_408 for k in range(n)]
        assert encoder.packed(ids) == np.array(ids, dtype).tobytes()


def test_pitman_yor_base_is_exact_and_scores_beat_it(docs, rows):
    got = pitman_yor.report(docs).collect()
    assert len(got) == len(rows)
    held = {r.doc_id: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows}
    count = Counter(w for r in rows if not held[r.doc_id] for w in [*plain.words(r.text), None])
    total = sum(count.values())
    want = defaultdict(list)
    for r in rows:
        w = [*plain.words(r.text), None]
        base = sum(math.log10((count[x] + 0.1) / (total + 0.1 * (len(count) + 1))) for x in w)
        want[r.doc_id].append((len(w), sum(count[x] > 0 for x in w), base))
    for r in got:
        n, known, base = want[r.doc_id][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_pitman_yor_is_a_distribution(spark):
    """Scores of texts of one and two words give every product of probabilities along a way from an end to
    the next. Such products fix the table of P(word | context) up to factors that leave its eigenvalues
    alone, and the largest one is one exactly where the words after each context sum to one."""
    train = [(2 * k, "a b a c a b d a b") for k in range(8)] + [(100 + k, "c a c") for k in range(4)]
    words = ["a", "b", "c", "d", "zz"]
    asked = ["", *words, *[f"{u} {w}" for u in words for w in words]]
    rows = [(k, t, False) for k, t in train] + [(1000 + k, t, True) for k, t in enumerate(asked)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, h boolean")
    got = {asked[r.doc_id - 1000]: 10**r.score for r in pitman_yor.score(df, F.col("h")).where("held_out").collect()}
    ways = [[got[""], *[got[w] for w in words]], *[[1.0, *[got[f"{u} {w}"] / got[u] for w in words]] for u in words]]
    assert max(abs(np.linalg.eigvals(np.array(ways)))) == pytest.approx(1, abs=1e-9)


def test_pitman_yor_scores_are_equal_on_any_partitioning(docs):
    one, many = ({(r.doc_id, r.n_tokens): r.score for r in pitman_yor.report(docs.repartition(n)).collect()} for n in (1, 9))
    assert one.keys() == many.keys()
    assert all(one[k] == pytest.approx(many[k], rel=1e-9) for k in one)


def test_keyed_binomials_follow_their_distribution():
    keys = np.arange(40_000, dtype=np.uint64)
    for n, p in [(1, 0.3), (7, 0.9), (60, 0.02), (400, 0.5), (5_000, 0.001), (3, 0.0), (3, 1.0)]:
        x = pitman_yor.binomials(np.full(len(keys), n), np.full(len(keys), p), keys, 1, 2)
        assert x.min() >= 0 and x.max() <= n
        assert x.mean() == pytest.approx(n * p, abs=4 * (n * p * (1 - p) / len(keys)) ** 0.5 + 1e-12)
        assert x.var() == pytest.approx(n * p * (1 - p), rel=0.05, abs=1e-12)


def test_pitman_yor_learns_what_follows_rare_words(spark):
    """Each rare word has a share far below 1e-4, and always the same word after it."""
    pairs = [f"rare{k} after{k}" for k in range(400)]
    filler = " ".join(f"w{k * k % 97}" for k in range(60_000))
    texts = [(k, x, False) for k, x in enumerate([*pairs * 3, *[filler] * 3])]
    texts += [(10_000, "rare7 after7", True), (10_001, "rare7 after8", True)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string, h boolean")
    got = {r.doc_id: r for r in pitman_yor.score(df, F.col("h")).where("held_out").collect()}
    assert got[10_000].base_score == pytest.approx(got[10_001].base_score)
    assert got[10_000].score > got[10_001].score + 2


def test_pitman_yor_without_training_rows(docs):
    got = pitman_yor.score(docs.limit(5), F.lit(True)).collect()
    assert len(got) == 5 and all(r.n_known == 0 and r.train_tokens == 0 for r in got)
    assert pitman_yor.report(empty(docs)).isEmpty()


def test_pitman_yor_leaves_no_table_of_its_sweeps(spark, docs):
    """Only the result's table stays; those of pairs and words go as soon as the next ones are written."""
    from pathlib import Path

    from kinweave.session import checkpoint_root

    root = Path(checkpoint_root(spark).removeprefix("file:"))
    before = set(root.glob("cut-*"))
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name)
    got = pitman_yor.report(docs)
    assert len(set(root.glob("cut-*")) - before) == 1 and spark.conf.get(name) == setting
    assert got.count() == docs.count()


def test_pitman_yor_moves_blocks_of_pairs_not_rows_of_them(spark, docs, rows, monkeypatch):
    """What the sweeps write has a row per block and for each two that tell each other something."""
    counts = []
    cut = pitman_yor.cut_lineage
    monkeypatch.setattr(pitman_yor, "cut_lineage", lambda *dfs: counts.append((out := cut(*dfs)).count()) or out)
    pitman_yor.report(docs)
    texts = [plain.words(r.text) for r in rows]
    seen = Counter(p for w in texts for p in zip([None, *w], [*w, None], strict=True))
    assert counts[-1] == len(rows) and sum(n > 1 for n in seen.values()) > 2_000
    assert max(counts[:-1]) <= 16 * 33 + 16


def test_pitman_yor_scores_are_equal_in_any_blocks_groups_and_passes(docs, monkeypatch):
    def scores():
        return {(r.doc_id, r.n_tokens): r.score for r in pitman_yor.report(docs).collect()}

    one = scores()
    for name, value in (("SHARE", 1 << 14), ("LEAST", 1 << 13), ("CHUNK", 1 << 14)):
        monkeypatch.setattr(pitman_yor, name, value)
    many = scores()
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k], rel=1e-9) for k in one)


def test_blocks_of_pairs_ask_few_ranges_of_words():
    import pyarrow as pa

    ranges, words = 20, [f"w{k * k % 9_973}" for k in range(60_000)]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(words * 2)]), pa.array([False])], names=["doc_id", "text", "held_out"])
    table = pa.Table.from_batches(pitman_yor._count(ranges * 16)([batch]))
    asked = Counter()
    for b in set(table["bucket"].to_pylist()):
        out = pitman_yor._start(ranges * 16)(table.filter(pa.compute.equal(table["bucket"], b))).to_pylist()
        asked.update(r["peer"] for r in out if r["kind"] == "ask")
        assert sum(r["kind"] == "block" for r in out) == 1
    assert 1 < max(asked.values()) <= 16 + ranges


def test_fields_are_ordered_alike_in_one_number_and_apart():
    rng = np.random.default_rng(1)
    fields = [rng.integers(0, n, 5_000) for n in (3, 40, 7)]
    short, wide = (pitman_yor._ordered(*[(x, n) for x, n in zip(fields, limits, strict=True)]) for limits in ((3, 40, 7), (1 << 30,) * 3))
    assert list(zip(*map(list, short), strict=True)) == sorted(zip(*map(list, fields), strict=True))
    assert all((a == b).all() for a, b in zip(short, wide, strict=True))
    for x in (np.array([-1, 200]), np.array([], np.int64), np.array([1 << 40, -5]), np.array([0.5]), np.array([1 << 63], np.uint64)):
        assert (pitman_yor._unpacked(pitman_yor._packed(x)) == x).all()


def test_pairs_that_occur_once_have_no_rows():
    import pyarrow as pa

    texts, held = ["a b c a b", "x a y x q", "y x z"], [False, False, True]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(texts), pa.array(held)], names=["doc_id", "text", "held_out"])
    table = pa.Table.from_batches(pitman_yor._count(1)([batch]))
    rows = [r for b in set(table["bucket"].to_pylist()) for r in pitman_yor._merge(table.filter(pa.compute.equal(table["bucket"], b))).to_pylist()]
    word = {w: int(pitman_yor._signed(hashes(pa.array([w])))[0]) for w in "abcxyzq"}
    assert [(r["u"], r["w"], r["c"]) for r in sorted(rows, key=lambda r: -(r["c"] or 0)) if r["w"] is not None] == [(word["a"], word["b"], 2), (word["y"], word["x"], 1)]
    sums = Counter()
    for r in rows:
        sums.update({(r["u"], k): r[k] or 0 for k in ("cw", "one_w", "cu", "one_u")} if r["w"] is None else {})
    assert [sums[word["a"], k] for k in ("cw", "one_w", "cu", "one_u")] == [3, 3, 3, 1]


def test_seating_draws_follow_the_two_customer_odds():
    d, opened = 0.5, 0.7
    keys = np.arange(40_000, dtype=np.uint64)
    t = pitman_yor.seat(np.full(40_000, 2), np.full(40_000, opened), d, keys, 0, pitman_yor._stirling(d))
    assert np.mean(t == 2) == pytest.approx(opened / (opened + 1 - d), abs=0.01)
    many = pitman_yor.seat(np.full(2_000, 400), np.full(2_000, opened), d, keys[:2_000], 0, pitman_yor._stirling(d))
    assert many.min() >= 1 and many.max() <= 400


def test_personal_data_is_that_of_plain_patterns(docs, rows):
    want = {}
    for r in rows:
        spans = plain.personal(r.text)
        want[r.doc_id] = (Counter(k for k, _, _ in spans), ",".join(f"{k}:{a}:{b}" for k, a, b in spans))
    got = pii.report(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        counts, spans = want[r.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert set(spans.split(",")) - {""} <= set(r.spans.split(","))
    assert pii.report(empty(docs)).isEmpty()


def test_personal_data_learns_looser_spans_from_votes(spark):
    rows = [(k, f"please call {200 + k % 700}-555-{1000 + k} today") for k in range(200)]
    rows += [(1000 + k, f"order no. serial {200 + k % 700}-555-{1000 + k}x7 sent") for k in range(200)]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[k] == "phone:12:24" for k in range(200))
    assert not any(got[1000 + k] for k in range(200))


def test_personal_data_does_not_depend_on_the_size_of_the_corpus():
    counts = {pii_code("phone", (1, 2, 2, 2)): 5, pii_code("phone", (1, 0, 0, 0)): 3, pii_code("ssn", (1, 2, 2, 2)): 7, pii_code("iban", (1, 2, 1, 2)): 2}
    want = pii.train(counts)
    assert pii_code("phone", (1, 2, 2, 2)) in want and pii_code("phone", (1, 0, 0, 0)) not in want
    for factor in (10, 1_000, 10_000_000):
        assert pii.train({k: factor * n for k, n in counts.items()}) == want
    # one pattern alone: accepted where the labelers agree, rejected where all are against
    for n in (1, 4_000, 8_000, 10_000_000):
        assert pii_code("phone", (1, 2, 2, 2)) in pii.train({pii_code("phone", (1, 2, 2, 2)): n})
        assert pii_code("phone", (1, 0, 0, 0)) not in pii.train({pii_code("phone", (1, 0, 0, 0)): n})


def pii_code(kind, votes, size=1, apart=1):
    code = pii.KINDS.index(kind)
    for v in votes:
        code = code * 3 + v
    return (code * 4 + size) * 3 + apart


def test_personal_data_of_a_text_with_very_many_spans(spark):
    phones = [f"{200 + k % 700}-555-{1000 + k % 9000}" for k in range(20_000)]
    ends = []
    parts = []
    at = 0
    for p in phones:
        parts.append(f"call {p} ")
        ends.append((at + 5, at + 5 + len(p)))
        at += len(p) + 6
    text = "".join(parts)
    (row,) = pii.report(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert row.spans == ",".join(f"phone:{a}:{b}" for a, b in ends)


def test_personal_data_keeps_the_spans_of_a_plain_walk(docs, spark):
    """Extra spans are those of taking looser spans one by one, in kind and start order, beside brute overlap."""
    more = [
        (9_000, "call 202-555-1234 mail joe (at) host (dot) com ssn 123-45-6789 iban DE12 3456 7890 1234 5678 90 10.0.0.1"),
        (9_001, "account GB12 2025 5512 3420 2555 and tel 202 555 1234 1111 2222 3333 4444 iban DE12 123-45-6789 phone 212.555.1234"),
        (9_002, "a (at) b.c (at) d.com (dot) org mail x@y.com (at) z.com bank DE89 3704 0044 0532 0130 00 5555 5555 5555 4444"),
    ]
    known = docs.select("doc_id", "text").union(spark.createDataFrame(more * 3, "doc_id bigint, text string"))
    strict, loose = pii.spans_of(F.coalesce("text", F.lit("")))
    judged = known.select("doc_id", strict.alias("strict"), loose.alias("loose")).collect()
    accepted = set(pii.train(Counter(s.code for r in judged for s in [*r.strict, *r.loose])))
    want = Counter()
    for r in judged:
        taken = [(s.start, s.end) for s in r.strict]
        own = []
        for s in sorted(r.loose, key=lambda s: (s.kind, s.start)):
            if s.code in accepted and all(s.end <= a or b <= s.start for a, b in taken):
                taken.append((s.start, s.end))
                own.append((s.kind, s.start, s.end))
        want[r.doc_id, tuple(own)] += 1
    assert sum(len(k[1]) * n for k, n in want.items()) > 3
    assert Counter((r.doc_id, tuple(sorted(tuple(s) for s in r.extra))) for r in pii.find(known).collect()) == want


def test_personal_data_runs_no_python(docs, capsys):
    pii.report(docs).explain()
    shown = capsys.readouterr().out
    assert "Python" not in shown and "Arrow" not in shown and "Pandas" not in shown


@pytest.mark.parametrize("n", [2, 5])
def test_near_copies_are_those_of_all_pairs(docs, rows, n):
    named = [r for r in rows if r.doc_id is not None]
    sets = {r.doc_id: plain.shingles(r.text, n) for r in named}
    want = plain.components(sets, plain.similar(sets, 80))
    got = minhash.near_copies(docs, words=n).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id == -5 and not r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], len(sets[r.doc_id]), want[r.doc_id] == r.doc_id)
    assert minhash.near_copies(empty(docs)).isEmpty()


def test_a_large_group_of_near_copies_is_whole(spark):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(400):
        w = list(base)
        for at in rng.choice(120, size=int(rng.integers(1, 9)), replace=False):
            w[at] = f"x{k}_{at}"
        texts.append((k, " ".join(w)))
    sets = {k: plain.shingles(t, 2) for k, t in texts}
    want = plain.components(sets, plain.similar(sets, 80))
    got = {r.doc_id: r.component_id for r in minhash.near_copies(spark.createDataFrame(texts, "doc_id bigint, text string"), words=2).collect()}
    assert got == want


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 40])
def test_decontamination_is_that_of_every_window(spark, docs, block_words):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(12).collect()]
    items += [(900, "One two"), (901, None), (902, " - "), (None, "mail"), (903, "long " * 11), (900, "eins zwei drei")]
    some = docs.where("doc_id < 60 or doc_id is null").where("length(text) < 20000 or text is null or doc_id = -7").collect()
    few = [(r.doc_id, (r.text or "")[:4000] if r.doc_id != -7 else "long " * 40) for r in some]
    few += [(5000, f"so {items[0][1].upper()} it"), (5001, f"{items[1][1]} x {items[2][1]}")]
    df = spark.createDataFrame(few, "doc_id bigint, text string")
    out, n, hits, found = decontaminate.mark(df, spark.createDataFrame(items, "item_id bigint, text string"), block_words=block_words)
    want = plain.overlaps(few, items)
    for r in out.collect():
        assert (r[n], len(r[hits]), sorted(r[found])) == want[r.doc_id]


def test_decontamination_removes_spans_or_documents(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id bigint, text string")
    df = spark.createDataFrame([(1, "See: A b, c d e f g h i j K! End.", "x"), (2, "clean", "y"), (3, None, None)], "doc_id bigint, text string, n_words string")
    assert sorted(r.doc_id for r in decontaminate.without_documents(df, items).collect()) == [2, 3]
    assert {r.doc_id: r.text for r in decontaminate.without_spans(df, items).collect()} == {1: "See: ! End.", 2: "clean", 3: None}
    assert decontaminate.report(df, items.where("false")).where("contaminated").isEmpty()
    assert decontaminate.report(df.where("false"), items).isEmpty()


def test_mixture_meets_targets_and_repeats(docs):
    planned = mixture.report(docs).cache()
    assert planned.count() == docs.count()
    per = defaultdict(lambda: [0, 0, 0.0, 0])
    source = {(r.doc_id, r.text): r.source for r in docs.collect()}
    named = mixture.plan(docs, "doc_id", "text", "source", mixture.WEIGHTS, mixture.MOST, 9)
    for r in named.collect():
        p = per[r._source]
        p[0] += r._size
        p[1] = max(p[1], r._size)
        p[2] = r._target
        p[3] += r._size * (r._copies + (r._h < r._below))
    total = sum(p[0] for p in per.values())
    order = sorted(per, key=lambda s: (s is None, s or ""))
    want = mixture.targets([per[s][0] for s in order], [mixture.WEIGHTS[k % 3] for k in range(len(order))])
    for s, goal in zip(order, want, strict=True):
        assert per[s][2] == goal <= 3 * per[s][0] + 1e-6
        assert abs(per[s][3] - goal) <= per[s][1]
    assert sum(want) <= total + 1e-6
    assert planned.where("taken > 3 * size").isEmpty()
    assert mixture.report(docs).exceptAll(planned).isEmpty()
    taken = mixture.mix(docs)
    assert taken.columns == docs.columns and len(source) > 0
    words = F.coalesce(F.regexp_count("text", F.lit(SPACED_WORD)), F.lit(0))
    assert taken.agg(F.sum(words)).first()[0] == planned.agg(F.sum("taken")).first()[0]
    assert mixture.report(empty(docs)).isEmpty()


def test_targets_fill_up_to_three_sizes():
    got = mixture.targets([10, 1000, 0], [5, 2, 1])
    assert got == [30, 980.0, 0]
    assert mixture.targets([], []) == []


def test_shards_follow_the_turns(docs, rows):
    names = [f"s{k}" for k in range(7)]
    got = shard_table.fill(names, 101)
    claimed, at = {}, [0] * 7
    prefer = []
    for n in names:
        offset, step = (int.from_bytes(hashlib.md5(f"{salt}:{n}".encode()).digest()[:8], "big") for salt in ("offset", "step"))
        prefer.append([(offset % 101 + j * (step % 100 + 1)) % 101 for j in range(101)])
    while len(claimed) < 101:
        for k in range(7):
            if len(claimed) == 101:
                break
            while prefer[k][at[k]] in claimed:
                at[k] += 1
            claimed[prefer[k][at[k]]] = k
    assert got == [claimed[s] for s in range(101)]
    counts = Counter(got)
    assert max(counts.values()) - min(counts.values()) <= 1
    moved = sum(a != b for a, b in zip(got, shard_table.fill(names[:6], 101), strict=True) if a != 6)
    assert moved < 30
    placed = shard_table.report(docs).collect()
    assert len(placed) == len(rows)
    table = shard_table.fill([f"shard-{k:03d}" for k in range(shard_table.SHARDS)])
    for r in placed:
        key = f"i{r.doc_id}" if r.doc_id is not None else "tOne TWO\vtwo"
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % shard_table.SIZE
        assert (r.slot, r.shard) == (slot, f"shard-{table[slot]:03d}")
    with pytest.raises(ValueError):
        shard_table.fill(["a", "a"])
    assert shard_table.report(empty(docs)).isEmpty()
