from __future__ import annotations

from collections import Counter

import corpus_pipeline
from kinweave.llm import decontaminate, language, minhash, mixture, shard_table, templates
from tests.llm import plain

SMALL = "/root/testdata/sf0.001"


def test_stages_hold_step_by_step(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id = 3")).unionByName(spark.createDataFrame([(None, None, None, None, None), (None, "the only words here are these few ones", "en", None, 1)], docs.schema))
    seen, steps = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen, SMALL).write.parquet(f"{tmp_path}/{name}")
        before, seen = seen, spark.read.parquet(f"{tmp_path}/{name}")
        steps[name] = (before, seen)
        assert seen.columns[: len(docs.columns)] == docs.columns

    before, after = steps["language_id"]
    judge = language.Judge(language.fit(before))
    told = {t: judge.decide(t) for t in {r.text for r in before.collect()}}
    keep = [r.doc_id for r in before.collect() if told[r.text][0] != "und" and told[r.text][2] >= language.MARGIN]
    assert Counter(r.doc_id for r in after.collect()) == Counter(keep)

    before, after = steps["near_copies"]
    named = [r for r in before.collect() if r.doc_id is not None]
    sets = {r.doc_id: plain.shingles(r.text, 5) for r in named}
    root = plain.components(sets, plain.similar(sets, 80))
    want = [i for i in sets if root[i] == i]
    assert sorted(r.doc_id for r in after.collect() if r.doc_id is not None) == sorted(want)

    before, after = steps["benchmark_free"]
    marked = decontaminate.report(before, spark.read.parquet(f"{SMALL}/benchmark.parquet")).where("not contaminated")
    assert Counter(r.doc_id for r in after.collect()) == Counter(r.doc_id for r in marked.collect())

    before, after = steps["source_mix"]
    planned = {r.doc_id: (r.size, r.taken) for r in mixture.report(before).collect()}
    counts = Counter(r.doc_id for r in after.collect())
    assert all(counts[i] * size == taken for i, (size, taken) in planned.items())

    before, after = steps["shards"]
    assert after.count() == before.count() and {"slot", "shard"} <= set(after.columns)
    assert minhash.MINIMA == 160


def test_pipeline_over_empty_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.isEmpty()


def test_near_copies_tell_rows_apart_by_id_and_text(spark):
    first, other = ("one two three four five six seven eight nine ten " * 3, "an entirely different passage about rivers boats and lakes in spring")
    long = " ".join(f"w{k * k % 9973}" for k in range(60_000))
    rows = [
        (1, first), (1, first), (1, other),  # two unlinked texts with one id, one of them twice
        (2, first), (3, long), (4, long + " more"), (None, long), (None, other),
        (None, "a text that only rows without any id at all do hold"), (None, "a text that only rows without any id at all do hold"),
        (5, None), (5, None), (6, " "), (None, None), (7, "short"), (8, "short"),
    ]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, kept_id string, Component int")
    got = corpus_pipeline.near_copies(spark, docs, SMALL)
    assert got.columns == docs.columns
    want = [(1, first), (1, other), (3, long), rows[8], (5, None), (5, None), (6, " "), (None, None), (7, "short")]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(want)


def test_operators_keep_columns_with_the_names_they_use_themselves(spark):
    names = ["mix_source", "MIX_COPIES", "mix_hash", "_source", "_h", "slot", "Shard", "n_words", "hit_words", "Hit_Items", "a.b"]
    words = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(20)]
    docs = spark.createDataFrame(
        [(k, w, "ab"[k % 2], *[f"{n}{k}" for n in names]) for k, w in enumerate(words)],
        ", ".join(["doc_id bigint", "text string", "source string", *[f"`{n}` string" for n in names]]),
    )
    exam = spark.createDataFrame([("i", " ".join(words[3].split()[5:15]))], "item_id string, text string")
    extra = lambda rows: {(r["doc_id"], *[r[n] for n in names]) for r in rows}
    own = extra(docs.collect())

    told, new = language.identify(docs, {})
    assert told.columns == [*docs.columns, *new] and extra(told.collect()) == own
    mixed = mixture.mix(docs)
    assert mixed.columns == docs.columns and extra(mixed.collect()) <= own
    placed, slot, shard = shard_table.place(docs)
    assert placed.columns[: len(docs.columns)] == docs.columns and not {slot.lower(), shard.lower()} & {n.lower() for n in names}
    assert extra(placed.collect()) == own
    clean = decontaminate.without_documents(docs, exam)
    assert clean.columns == docs.columns and extra(clean.collect()) == {r for r in own if r[0] != 3}


def test_pages_and_benchmark_may_be_empty(spark):
    pages, exam, docs = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("pages", "benchmark", "documents"))
    assert templates.extract(pages.where("false")).isEmpty()
    assert decontaminate.report(docs.where("false"), exam).isEmpty()
    got = decontaminate.report(docs.where("doc_id < 20"), exam.where("false")).collect()
    assert got and all((r.n_hit, r.n_items, r.contaminated) == (0, 0, False) and r.n_words > 0 for r in got)
