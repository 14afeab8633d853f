from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import matching, review, skew
from tests import scores

FIRST = "ann anna anne bob robert rob jane joan john jo li mei raj".split()
LAST = "doe dole smith smyth smit lee li patel patil jones johns".split()
FIRMS = ["Acme", "Acme Inc", "Acme Labs", "Acne", "Globex", "Globe X", "Initech LLC", "Init", "A", "Be"]


def people_rows(n: int, seed: int) -> list[dict]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append(
            {
                "id": i,
                "tenant_id": rng.choice(["s", "t"]),
                "display_name": rng.choice([None, "!", "x"]) if rng.random() < 0.05 else f"{rng.choice(FIRST)} {rng.choice(LAST)}",
                "primary_email": rng.choice([None, f"m{rng.randrange(n // 2)}@x.example", f" M{rng.randrange(6)}@x.example"]),
                "company": rng.choice([None, "Inc", *FIRMS]),
                "title": None,
                "merged_into_id": 0 if rng.random() < 0.1 else None,
            }
        )
    return rows


def frame(spark, rows):
    return spark.createDataFrame(
        [tuple(r.values()) for r in rows],
        "id BIGINT, tenant_id STRING, display_name STRING, primary_email STRING, company STRING, title STRING, merged_into_id BIGINT",
    )


@pytest.mark.parametrize("threshold", [0.95, 0.85, 0.7, 0.55])
def test_similar_keys_equal_all_pairs(spark, threshold):
    rows = people_rows(160, 3)
    keys = matching.distinct_keys(matching.with_match_key(frame(spark, rows))).cache()
    listed = {r.match_key: (r.tenant_id, r.name_key, r.company_key) for r in keys.collect()}
    got = {(r.left_key, r.right_key): r.score for r in matching.similar_keys(keys, keys, threshold).collect()}
    expected = {}
    for a, (ta, an, ac) in listed.items():
        for b, (tb, bn, bc) in listed.items():
            if a != b and ta == tb:
                s = scores.key_score((an, ac), (bn, bc))
                if s >= threshold:
                    expected[(a, b)] = s
    assert got == expected
    assert len(expected) >= (2 if threshold > 0.9 else 20)


def test_salted_join_equals_join(spark):
    left = spark.range(400).select(F.when(F.col("id") < 300, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    right = spark.range(300).select(F.when(F.col("id") < 200, 1).otherwise(F.col("id") + 200).alias("k"), F.col("id").alias("b"))
    plain = sorted(left.join(right, "k").collect())
    assert sorted(skew.salted_join(left, right, ["k"], "a", pairs_per_task=50).select("k", "a", "b").collect()) == plain


def test_best_match_ties_go_to_the_smallest_id(spark):
    people = frame(
        spark,
        [
            {"id": 5, "tenant_id": "t", "display_name": "Jane Doe", "primary_email": None, "company": "Acme", "title": None, "merged_into_id": None},
            {"id": 3, "tenant_id": "t", "display_name": "Jane Doe", "primary_email": None, "company": "Acme Inc", "title": None, "merged_into_id": None},
            {"id": 1, "tenant_id": "u", "display_name": "Jane Doe", "primary_email": None, "company": "Acme Inc", "title": None, "merged_into_id": None},
        ],
    )
    records = spark.createDataFrame(
        [("t", "r1", "Jane Doe", "ACME"), ("t", "r2", "Jane Do", "Acme"), ("t", "r3", "Zed", "Acme"), ("t", "r4", "Jane Doe", None)],
        "tenant_id STRING, source_record_id STRING, display_name STRING, company STRING",
    )
    got = {r.source_record_id: (r.person_id, r.score) for r in matching.fuzzy_best_match(records, people).collect()}
    assert got["r1"] == (3, 1.0)
    assert got["r2"] == (3, scores.key_score(("jane do", "acme"), ("jane doe", "acme")))
    assert got["r3"] == got["r4"] == (None, None)


def brute_force_queue(rows: list[dict], n: int, named: dict) -> dict[str, list[tuple]]:
    """All pairs per tenant in the order the operator documents."""
    out = {}
    for tenant in {r["tenant_id"] for r in rows}:
        live = [r for r in rows if r["tenant_id"] == tenant and r["merged_into_id"] is None]
        mail = lambda r: (r["primary_email"] or "").strip().lower() or None
        shared = sorted(
            (a["id"], b["id"]) for a in live for b in live if a["id"] < b["id"] and mail(a) and mail(a) == mail(b)
        )
        key = lambda r: named[r["display_name"], r["company"]]
        fuzzy = []
        for a in live:
            for b in live:
                if all(key(a)) and all(key(b)) and key(a) < key(b) and not (mail(a) and mail(a) == mail(b)):
                    s = scores.key_score(key(a), key(b))
                    if 0.55 <= s < 0.999:
                        fuzzy.append((-s, key(a), key(b), a["id"], b["id"]))
        listed = [(1.0, a, b) for a, b in shared] + [(round(-f[0], 6), f[3], f[4]) for f in sorted(fuzzy)]
        out[tenant] = listed[:n]
    return out


@pytest.mark.parametrize("n,emails", [(25, True), (25, False), (400, True)])
def test_review_queue_equals_all_pairs(spark, n, emails):
    rows = people_rows(70, 11)
    if not emails:
        for r in rows:
            r["primary_email"] = None if r["id"] % 3 else "one@x.example" if r["id"] % 2 else f"{r['id']}@x.example"
    people = frame(spark, rows)
    sources = spark.createDataFrame([(r["id"] % 9, "gmail") for r in rows], "person_id BIGINT, source_type STRING")
    got: dict[str, list] = {}
    queue = review.review_queue(people, sources, n).collect()
    for r in sorted(queue, key=lambda r: r.place):
        got.setdefault(r.tenant_id, []).append((r.a_id, r.b_id))
    expected = {t: [(a, b) for _, a, b in pairs] for t, pairs in brute_force_queue(rows, n, scores.keys(spark, rows)).items() if pairs}
    assert got == expected
    counts = {p: sum(1 for r in rows if r["id"] % 9 == p) for p in range(9)}
    for r in queue:
        a, b = counts.get(r.a_id, 0), counts.get(r.b_id, 0)
        assert (r.winner_id, r.loser_id) == ((r.a_id, r.b_id) if a >= b else (r.b_id, r.a_id))


def test_shared_email_groups_hold_all_pairs(spark):
    rows = people_rows(60, 5)
    got = review.shared_email_groups(frame(spark, rows)).collect()
    pairs = {(a.person_id, b.person_id) for a in got for b in got if (a.tenant_id, a.email) == (b.tenant_id, b.email) and a.person_id < b.person_id}
    mail = lambda r: (r["primary_email"] or "").strip().lower()
    live = [r for r in rows if r["merged_into_id"] is None and mail(r)]
    assert pairs == {
        (a["id"], b["id"]) for a in live for b in live
        if a["tenant_id"] == b["tenant_id"] and mail(a) == mail(b) and a["id"] < b["id"]
    }
