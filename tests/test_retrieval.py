from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinweave import schemas
from kinweave.functions.words import hashed_words
from kinweave.operators import aggregates, evaluation, ranking
from kinweave.plans import retrieval

# A small network, and questions with the people who answer them.
NETWORK = [
    ("dora", "Dora Kessel", "dora@northwind.example", "Northwind", "Glaciologist", "Dora Kessel, glaciologist at Northwind: sea ice and climate models"),
    ("omar", "Omar Haddad", "omar@northwind.example", "Northwind", "Drilling Lead", "Omar Haddad, drilling lead at Northwind: ice cores, field equipment"),
    ("yuki", "Yuki Tanabe", "yuki@harborlight.example", "Harborlight", "Luthier", "Yuki Tanabe, luthier at Harborlight: violin restoration"),
    ("nils", "Nils Aune", "nils@harborlight.example", "Harborlight", "Accountant", "Nils Aune, accountant at Harborlight: payroll and tax"),
    ("bea", "Bea Okafor", "bea@tessel.example", "Tessel Gardens", "Botanist", "Bea Okafor, botanist at Tessel Gardens: alpine plants, seed banks"),
    ("leo", "Leo Marsh", None, "Quillwork", "Typesetter", "Leo Marsh, typesetter at Quillwork: book printing"),
]
TOUCHES = [
    ("yuki", "gmail", "email_sent", 5, "Bow repair"),
    ("yuki", "calendar", "meeting", 45, "Workshop tour"),
    ("bea", "calendar", "meeting", 20, "Seed exchange"),
    ("omar", "gmail", "email_received", 200, "Core samples"),
]
# question: (route, people who answer it)
ASKED = {
    "which people work at Northwind": ("company", {"dora", "omar"}),
    "anyone at Harborlight that I met?": ("company", set()),
    "my connections at Tessel Gardens": ("company", {"bea"}),
    "when did I last speak with Yuki?": ("recency", {"yuki"}),
    "last email to Omar Haddad": ("recency", set()),
    "when was the most recent meeting": ("recency", {"yuki", "bea"}),
    "somebody for violin restoration": ("semantic", {"yuki"}),
    "help with payroll and tax": ("semantic", {"nils"}),
    "alpine plants": ("semantic", {"bea"}),
    "ice cores": ("semantic", {"omar", "dora"}),
    "when did I last meet anyone at Harborlight": ("hybrid", {"yuki"}),
}
NOBODY = ["beekeeping hobbyists", "which friend races motorcycles"]


@pytest.fixture(scope="module")
def network(spark):
    people = spark.createDataFrame([(k, "t", n, e, c, t, None) for k, n, e, c, t, _ in NETWORK], schemas.PEOPLE)
    touches = spark.createDataFrame(
        [("t", s, f"{p}:{d}", f"{p}:{d}", p, kind, d, subject) for p, s, kind, d, subject in TOUCHES],
        "tenant_id STRING, source_type STRING, source_record_id STRING, external_id STRING, person_id STRING, interaction_type STRING, days INT, subject STRING",
    ).select("*", (F.lit("2026-01-01").cast("timestamp") - F.make_interval(days="days")).alias("occurred_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
    chunks = spark.createDataFrame(
        [(f"seed:{k}", "t", "contacts", k, body) for k, *_, body in NETWORK],
        "chunk_id STRING, tenant_id STRING, source_type STRING, person_id STRING, chunk_text STRING",
    )
    return people, touches, chunks


def test_evaluation_gates(spark, network):
    people, touches, chunks = network
    asked = spark.createDataFrame([(q, "t", q) for q in [*ASKED, *NOBODY]], "qid STRING, tenant_id STRING, question STRING")
    cited = retrieval.answer(asked, people, touches, chunks).cache()
    labels = spark.createDataFrame([(q, route) for q, (route, _) in ASKED.items()] + [(q, "semantic") for q in NOBODY], "qid STRING, label STRING")
    routed = retrieval.route_questions(asked).withColumn("intent", F.when(F.col("intent") == "ambiguous", "hybrid").otherwise(F.col("intent")))
    assert evaluation.intent_accuracy(routed, labels).first().accuracy >= 0.9
    who = people.select(F.col("primary_email").alias("email"), F.col("id").alias("person_id"))
    hits = cited.join(who, "email")
    relevant = spark.createDataFrame([(q, p) for q, (_, people) in ASKED.items() for p in people], "qid STRING, person_id STRING")
    result = evaluation.mean_recall(hits, relevant).first()
    assert result.questions == sum(bool(p) for _, p in ASKED.values()) and result.mean_recall >= 0.8
    zero = spark.createDataFrame([(q,) for q in NOBODY], "qid STRING")
    assert evaluation.answered_zero_questions(hits, zero).count() == 0
    assert evaluation.ungrounded(cited, people).count() == 0
    fake = cited.limit(1).withColumn("email", F.lit("ghost@x.com"))
    assert evaluation.ungrounded(fake.unionByName(fake.withColumn("email", F.lit(None).cast("string"))), people).count() == 1

    lines = {r.qid: r.context for r in retrieval.context_lines(cited, asked).collect()}
    assert lines["my connections at Tessel Gardens"] == "[1] Bea Okafor at Tessel Gardens (via Contacts): Bea Okafor — Botanist at Tessel Gardens"
    assert lines["when did I last speak with Yuki?"].splitlines()[0] == "[1] Yuki Tanabe at Harborlight (via Gmail): email_sent on 2025-12-27: Bow repair"
    assert lines[NOBODY[1]] == retrieval.NOTHING_FOUND
    mixed = lines["when did I last meet anyone at Harborlight"].splitlines()
    assert len(mixed) <= 8 and mixed[0].startswith("[1] Yuki Tanabe")


def test_hidden_people_and_deleted_touches_stay_hidden(spark, network):
    people, touches, chunks = network
    people = people.withColumn("merged_into_id", F.when(F.col("id") == "dora", "omar"))
    touches = touches.withColumn("deleted_at", F.when(F.col("subject") == "Workshop tour", F.col("occurred_at")))
    asked = spark.createDataFrame([("q", "t", "sea ice and climate")], "qid STRING, tenant_id STRING, question STRING")
    found = {r.person for r in retrieval.answer(asked, people, touches, chunks).collect()}
    assert "Omar Haddad" in found and "Dora Kessel" not in found
    latest = retrieval.recency_citations(touches, people).collect()
    assert {r.snippet for r in latest} == {"email_sent on 2025-12-27: Bow repair", "meeting on 2025-12-12: Seed exchange", "email_received on 2025-06-15: Core samples"}


def test_unknown_times_come_last_and_names_are_no_patterns(spark, network):
    people, touches, _ = network
    touches = touches.withColumn("occurred_at", F.when(F.col("person_id") != "bea", F.col("occurred_at")))
    rows = sorted(retrieval.recency_citations(touches, people).collect(), key=lambda r: r.place)
    assert rows[-1].snippet == "meeting on unknown date: Seed exchange"
    slots = spark.createDataFrame([("t", s) for s in ("a%", "yUKI", "r", "", "zzz", "Bea Okafor")], "tenant_id STRING, slot STRING")
    got = {(r.slot, r.person) for r in retrieval.recency_by_name(slots, touches, people).collect()}
    assert got == {("yUKI", "Yuki Tanabe"), ("r", "Omar Haddad"), ("r", "Bea Okafor"), ("Bea Okafor", "Bea Okafor")}


def test_contains_equals_all_comparisons(spark):
    rng = random.Random(2)
    texts = sorted({"".join(rng.choice("abcA ") for _ in range(rng.randint(1, 9))) for _ in range(120)})
    parts = sorted({"".join(rng.choice("abc ") for _ in range(rng.randint(1, 5))) for _ in range(60)})
    values = spark.createDataFrame([(t, v) for v in texts for t in ("s", "t")][:200], "tenant_id STRING, v STRING")
    slots = spark.createDataFrame([("t", p) for p in parts], "tenant_id STRING, p STRING")
    listed = [r.v for r in values.where("tenant_id = 't'").collect()]
    got = sorted((r.p, r.v) for r in ranking.contains_matches(slots, values, "p", "v").collect())
    assert got == sorted((p, v) for p in parts for v in listed if p.lower() in v.lower())


@pytest.mark.parametrize("per_pass", [4096, 3])
def test_vector_topk_equals_sorting_everything(spark, monkeypatch, per_pass):
    monkeypatch.setattr(ranking, "QUESTIONS_PER_PASS", per_pass)
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(90, 6)).round(1)
    vectors[7] = 0.0
    vectors[8] = vectors[9] = vectors[10]
    chunks = [("s" if i % 3 else "t", i, vectors[i].tolist()) for i in range(90)]
    asked = [("s" if i % 2 else "t", i, rng.normal(size=6).round(1).tolist()) for i in range(10)]
    got = ranking.vector_topk(
        spark.createDataFrame(chunks, "tenant_id STRING, chunk_id BIGINT, embedding ARRAY<FLOAT>").repartition(3),
        spark.createDataFrame(asked, "tenant_id STRING, qid BIGINT, embedding ARRAY<FLOAT>"),
        5,
    ).collect()
    seen = {(r.qid, r.place): (r.chunk_id, round(r.score, 9)) for r in got}
    expected = {}
    for tenant, q, v in asked:
        v = np.float32(v).astype(float)
        scored = []
        for t, c, x in chunks:
            x = np.float32(x).astype(float)
            if t == tenant and np.any(x):
                scored.append((-round(float(x @ v / np.sqrt(x @ x) / np.sqrt(v @ v)), 9), c))
        for place, (s, c) in enumerate(sorted(scored)[:5], 1):
            expected[(q, place)] = (c, -s)
    assert {k: v[1] for k, v in seen.items()} == pytest.approx({k: v[1] for k, v in expected.items()})
    assert {k: v[0] for k, v in seen.items()} == {k: v[0] for k, v in expected.items()}


def test_floor_counts_after_the_topk(spark):
    hits = spark.createDataFrame([(1, 0.05), (2, 0.04999), (3, 0.9)], "chunk_id INT, score DOUBLE")
    assert {r.chunk_id for r in ranking.above_floor(hits).collect()} == {1, 3}


def test_equal_citations_stay_outside_the_hybrid_route(spark):
    rows = [("q1", True, 0, 1, "a"), ("q1", True, 2, 1, "a"), ("q1", True, 1, 1, "b"), ("q2", False, 1, 1, "a"), ("q2", False, 1, 2, "a")]
    found = spark.createDataFrame(rows, "qid STRING, mixed BOOLEAN, branch INT, place INT, snippet STRING").select("*", F.lit("p").alias("person"), F.lit("c").alias("company"))
    got = sorted((r.qid, r.place, r.snippet) for r in retrieval.first_citations(found).collect())
    assert got == [("q1", 1, "a"), ("q1", 2, "b"), ("q2", 1, "a"), ("q2", 2, "a")]


def test_pages(spark):
    rows = [(str(i), "t", None if i == 0 else f"n{i:03d}", None, None, None, "x" if i == 1 else None) for i in range(300)]
    people = spark.createDataFrame(rows, schemas.PEOPLE)
    assert [r.id for r in ranking.people_page(people, 2).collect()] == ["2", "3"]
    assert ranking.people_page(people, 1000).count() == 200
    assert [r.id for r in ranking.people_page(people, 3, 297).collect()] == ["299", "0"]


def test_source_status(spark):
    tenants = spark.createDataFrame([("a",), ("b",), ("c",)], "tenant_id STRING")
    per_source = spark.createDataFrame([("a", "gmail", 1234), ("b", "linkedin", 2)], "tenant_id STRING, source_type STRING, people BIGINT")
    synced = spark.createDataFrame([("a", "gmail", "2024-01-01 10:00:00")], "tenant_id STRING, source_type STRING, at STRING").select("tenant_id", "source_type", F.col("at").cast("timestamp").alias("last_synced_at"))
    flags = spark.createDataFrame([("a", True, False), ("b", True, True)], "tenant_id STRING, connected BOOLEAN, expired BOOLEAN")
    out = aggregates.source_status(tenants, per_source, synced, flags, F.lit("2024-01-01 12:00:00").cast("timestamp"))
    got = {(r.tenant_id, r.source_type): (r.status, r.meta, r.action) for r in out.collect()}
    assert len(got) == 12
    assert got["a", "gmail"] == ("on", "1,234 people · synced 2h ago", "re-sync")
    assert got["a", "contacts"] == ("on", "connected · run a sync", "re-sync")
    assert got["b", "gmail"] == ("reconnect", "access expired · reconnect", "reconnect")
    assert got["b", "linkedin"] == ("on", "2 people", "re-sync")
    assert got["c", "linkedin"] == ("off", "CSV import", "import")
    assert got["c", "gmail"] == ("off", "metadata only · headers", "connect")
    assert got["c", "contacts"] == ("off", "not connected", "connect")


def test_hashed_vectors_retrieve_too(spark, network):
    people, touches, chunks = network
    embed = hashed_words(512)
    rows = [(r.chunk_id, r.tenant_id, r.source_type, r.person_id, r.chunk_text, embed([r.chunk_text])[0]) for r in chunks.collect()]
    vectors = spark.createDataFrame(
        rows,
        "chunk_id STRING, tenant_id STRING, source_type STRING, person_id STRING, chunk_text STRING, embedding ARRAY<FLOAT>",
    )
    asked = spark.createDataFrame([("q", "t", "who restores violins", embed(["violin restoration"])[0])], "qid STRING, tenant_id STRING, question STRING, embedding ARRAY<FLOAT>")
    best = retrieval.semantic_citations(asked, vectors, people, k=1, by_words=False).first()
    assert best.person == "Yuki Tanabe"


def test_approximate_search_finds_most_of_the_exact_answer(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    vectors = centres[rng.integers(0, 12, 600)] + 0.3 * rng.normal(size=(600, 16))
    chunks = spark.createDataFrame([("t", i, v.tolist()) for i, v in enumerate(vectors)], "tenant_id STRING, chunk_id BIGINT, embedding ARRAY<FLOAT>")
    asked = spark.createDataFrame([("t", i, c.tolist()) for i, c in enumerate(centres)], "tenant_id STRING, qid BIGINT, embedding ARRAY<FLOAT>")
    exact = ranking.vector_topk(chunks, asked).select("qid", F.col("chunk_id").alias("person_id"))
    near = ranking.vector_topk_approximate(chunks, asked).select("qid", F.col("chunk_id").alias("person_id"))
    assert evaluation.mean_recall(near, exact).first().mean_recall >= 0.9


def test_vectors_of_other_lengths_and_missing_ones_match_nothing(spark):
    vectors = "tenant_id string, chunk_id bigint, embedding array<float>"
    chunks = spark.createDataFrame(
        [("a", 1, [1.0, 0.0]), ("a", 2, [1.0, 0.0, 0.0]), ("a", 3, []), ("a", 4, None), ("a", 5, [0.0, 0.0]), ("b", 6, [1.0, 0.0])], vectors
    )
    asked = spark.createDataFrame(
        [("a", 1, [2.0, 0.0]), ("a", 2, [0.0, 3.0, 0.0]), ("a", 3, []), ("a", 4, None), ("c", 5, [1.0, 0.0])], vectors.replace("chunk_id", "qid")
    )
    got = sorted((r.qid, r.chunk_id, r.score) for r in ranking.vector_topk(chunks, asked).collect())
    assert got == [(1, 1, 1.0), (2, 2, 0.0)]
    assert ranking.vector_topk(chunks, asked.where("false")).isEmpty()
    assert ranking.vector_topk_approximate(chunks, asked.where("false")).isEmpty()
    assert {r.chunk_id for r in ranking.vector_topk_approximate(chunks, asked).collect()} <= {2}


def test_equal_questions_get_equal_hits_within_their_tenant(spark, monkeypatch):
    monkeypatch.setattr(ranking, "QUESTIONS_PER_PASS", 2)
    chunks = spark.createDataFrame(
        [("a", 1, "planting seeds"), ("a", 2, "seed banks"), (None, 3, "seed"), ("b", 4, None), ("b", 5, "ice")],
        "tenant_id string, chunk_id bigint, chunk_text string",
    )
    asked = spark.createDataFrame(
        [("a", 1, "seeds plant"), ("a", 2, "plants seed"), ("a", 3, None), ("a", 4, ""), ("b", 5, "seeds plant"), (None, 6, "Seeds"), ("b", 7, "ice")],
        "tenant_id string, qid bigint, question string",
    )
    got = {}
    for r in ranking.words_topk(chunks, asked).where("score > 0").collect():
        got.setdefault(r.qid, {})[r.chunk_id] = round(r.score, 6)
    assert got == {1: {1: 1.0, 2: 0.5}, 2: {1: 1.0, 2: 0.5}, 6: {3: 1.0}, 7: {5: 1.0}}


@pytest.mark.parametrize("share, cells", [(0.0, 40), (0.01, 4_000_000), (2.0, 1)])
def test_word_search_equals_sorting_everything(spark, monkeypatch, share, cells):
    """Dense and listed stems, several passes and pieces; the texts' stems are cut once, whatever the passes."""
    monkeypatch.setattr(ranking, "QUESTIONS_PER_PASS", 12)
    monkeypatch.setattr(ranking, "CELLS_PER_PIECE", cells)
    monkeypatch.setattr(ranking, "DENSE_SHARE", share)
    rng = random.Random(5)
    words = [f"w{i}x" for i in range(40)]

    def text(longest):
        return " ".join(words[min(39, int(rng.expovariate(0.15)))] for _ in range(rng.randint(0, longest)))

    chunks = [("a" if i % 3 else "b", i, text(30)) for i in range(150)]
    asked = [("a" if i % 2 else "b", i, text(8)) for i in range(40)]
    found = ranking.words_topk(
        spark.createDataFrame(chunks, "tenant_id string, chunk_id bigint, chunk_text string").repartition(2),
        spark.createDataFrame(asked, "tenant_id string, qid bigint, question string"),
        5,
    )
    assert "regexp_extract_all" not in found._jdf.queryExecution().toString()
    expected = {}
    for tenant, q, question in asked:
        own, scored = Counter(question.split()), []
        for t, c, body in chunks:
            bag = Counter(body.split())
            if t == tenant and own and bag:
                dot = sum(n * bag[w] for w, n in own.items())
                scored.append((-dot / np.sqrt(float(sum(n * n for n in own.values()) * sum(n * n for n in bag.values()))), c))
        expected.update({(q, place): (c, -s) for place, (s, c) in enumerate(sorted(scored)[:5], 1)})
    assert {(r.qid, r.place): (r.chunk_id, r.score) for r in found.collect()} == expected


def test_recall_in_groups_equals_recall_per_question(spark):
    rng = random.Random(8)
    members = spark.createDataFrame([(rng.choice("stu"), rng.choice(["x", "y", None]), i) for i in range(60)], "tenant_id string, company string, person_id bigint")
    asked = spark.createDataFrame([(f"q{i % 25}", t, c) for i, t, c in ((i, "stuv"[i % 4], "xy"[i % 2]) for i in range(25))] + [("q0", "s", "x")], "qid string, tenant_id string, company string")
    hits = spark.createDataFrame([(f"q{rng.randrange(30)}", rng.randrange(70)) for _ in range(300)], "qid string, person_id bigint")
    group = ["tenant_id", "company"]
    expected = evaluation.recall_per_question(hits, asked.join(members, group))
    got = evaluation.recall_in_groups(hits, asked, members, group)
    assert sorted(got.collect()) == sorted(expected.collect()) and expected.count() > 10
    assert evaluation.mean_of(got).first().mean_recall == pytest.approx(evaluation.mean_recall(hits, asked.join(members, group)).first().mean_recall)


def test_bags_keep_every_text_and_pieces_meet_only_questions_in_reach(spark, monkeypatch):
    """Texts of a tenant travel packed, whatever the sizes; questions that no text of a piece can reach are left out."""
    monkeypatch.setattr(ranking, "PACKED", 7)
    monkeypatch.setattr(ranking, "TEXT_AT_ONCE", 400)
    rng = random.Random(3)
    tongues = ["the of and seas running".split(), "der die und wasser berge".split()]
    texts = [(rng.choice(["a", "b", None]), i, " ".join(rng.choice(tongues[i % 2]) for _ in range(rng.randint(0, 25)))) for i in range(120)] + [("a", 120, None)]
    chunks = spark.createDataFrame(texts, "tenant_id string, chunk_id bigint, chunk_text string").repartition(1)
    packed = ranking._bags(chunks.select("tenant_id", "chunk_id", F.col("chunk_text").alias("text"))).toArrow().to_batches()
    tenants = ["a", "b", None]
    streams = [(tenant, piece) for batch in packed for tenant, piece in ranking._unpacked(batch, dict.fromkeys(tenants))]
    assert all(piece.num_rows <= 7 for _, piece in streams)
    got = {(tenant, r["chunk_id"]): dict(zip(r["stems"], r["counts"])) for tenant, piece in streams for r in piece.to_pylist()}
    cut = {"seas": "sea", "running": "runn"}
    assert got == {(t, i): dict(Counter(cut.get(w, w) for w in (text or "").split())) for t, i, text in texts}

    met = []
    offer = ranking._Best.offer
    monkeypatch.setattr(ranking._Best, "offer", lambda self, scores, *rest: (met.append(scores.shape[1]), offer(self, scores, *rest)))
    captured = {}
    monkeypatch.setattr(ranking, "_search", lambda *args, **kw: captured.setdefault("prepare", args[5]) and chunks.select(F.lit("q").alias("qid"), "chunk_id", F.lit(1.0).alias("score"), F.lit(1).alias("place")))
    asked = [("a", f"q{i}", text) for i, text in enumerate(["the sea and the seas", "der die", "wasser und berge", ""])]
    ranking.words_topk(chunks, spark.createDataFrame(asked, "tenant_id string, qid string, question string"), 2)
    block = pa.table({"stems": pa.array([["and", "sea", "sea", "the", "the"], ["der", "die"], ["berg", "und", "wasser"], []], pa.list_(pa.string()))})
    score, best = captured["prepare"](block), ranking._Best(2, 4)
    monkeypatch.setattr(ranking, "TEXT_AT_ONCE", 1_000_000)
    packed = ranking._bags(chunks.select("tenant_id", "chunk_id", F.col("chunk_text").alias("text"))).toArrow().to_batches()
    pieces = [piece for batch in packed for _, piece in ranking._unpacked(batch, {"a": []})]
    for piece in pieces:
        best.offer(*score(piece, best.floor), piece.column("chunk_id").to_numpy(zero_copy_only=False))
    assert met[0] == 4 and min(met) < 4


def test_texts_of_chunks_are_moved_once_after_the_choice(spark, monkeypatch):
    """The union is decided by hashes; equal texts and a text equal to another branch's snippet still count as equal."""
    seen = []
    first = retrieval.first_citations
    monkeypatch.setattr(retrieval, "first_citations", lambda found, *rest: (seen.append(found.where("branch = 2 and snippet is not null")), first(found, *rest))[1])
    people = spark.createDataFrame([("t", "p", "Ann", None, "Acme", "CEO", None)], "tenant_id string, id string, display_name string, primary_email string, company string, title string, merged_into_id string")
    chunks = spark.createDataFrame(
        [("t", 1, "p", "gmail", "Ann, CEO at Acme"), ("t", 2, "p", "gmail", "ceo acme"), ("t", 3, "p", "gmail", "ceo acme"), ("t", 4, "p", "gmail", "ceo")],
        "tenant_id string, chunk_id bigint, person_id string, source_type string, chunk_text string",
    )
    interactions = spark.createDataFrame([], "tenant_id string, person_id string, source_type string, source_record_id string, interaction_type string, occurred_at timestamp, subject string, deleted_at timestamp")
    routed = spark.createDataFrame([("q", "t", "ceo acme", "hybrid", "acme", None)], "qid string, tenant_id string, question string, intent string, company_slot string, name_slot string")
    snippet = retrieval.company_citations(routed.withColumnRenamed("company_slot", "slot"), people).first().snippet
    chunks = chunks.withColumn("chunk_text", F.when(F.col("chunk_id") == 1, snippet).otherwise(F.col("chunk_text")))
    out = retrieval.retrieve(routed, people, interactions, chunks).orderBy("place").collect()
    assert [(r.place, r.source_type, r.snippet) for r in out] == [(1, "contacts", snippet), (2, "gmail", "ceo acme"), (3, "gmail", "ceo")]
    assert seen[0].isEmpty()
