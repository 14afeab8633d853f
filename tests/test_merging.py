from __future__ import annotations

import random

from pyspark.sql import functions as F

from kinweave import schemas
from kinweave.operators import keyed, merging, resolution


def network(spark, people, sources, interactions=(), chunks=(), aliases=()):
    make = spark.createDataFrame
    return merging.Network(
        make(list(people), schemas.PEOPLE),
        make([("t", "contacts", rid, pid, None, None) for rid, pid in sources], schemas.PERSON_SOURCES),
        make(list(aliases), schemas.PERSON_ALIASES),
        make([("t", "contacts", rid, rid, pid, "meeting", None, "s", None) for rid, pid in interactions], schemas.INTERACTIONS),
        make([("t", "contacts", rid, rid, "h", pid, "text", [0.0] * 4) for rid, pid in chunks], schemas.CHUNKS),
    )


def person(pid, into=None, email=None):
    return (pid, "t", pid, email, None, None, into)


def merges(spark, *pairs):
    return spark.createDataFrame([(i, "t", w, l) for i, (w, l) in enumerate(pairs)], "pos INT, tenant_id STRING, winner_id STRING, loser_id STRING")


def owners(df):
    return {r.source_record_id: r.person_id for r in df.collect()}


def test_merge_sticks_and_unmerge_restores(spark):
    before = network(spark, [person("W"), person("L", email="l@x.com")], [("c:W", "W"), ("c:L", "L")], [("c:L", "L")], [("c:L", "L")])
    after, verdicts = merging.merge_people(before, merges(spark, ("W", "L")))
    assert [v.accepted for v in verdicts.collect()] == [True]
    assert owners(after.sources) == {"c:W": "W", "c:L": "W"}
    assert owners(after.interactions) == owners(after.chunks) == {"c:L": "W"}
    assert {p.id: p.merged_into_id for p in after.people.collect()} == {"W": None, "L": "W"}
    alias = after.aliases.collect()
    assert [(a.source_record_id, a.person_id, a.decided_by, a.merged_from_id) for a in alias] == [("c:L", "W", "manual", "L")]

    again = spark.createDataFrame([("t", "contacts", "c:L", "L", "l@x.com", None, None, "x", None, 1)], schemas.RECORD + ", pos INT")
    assert resolution.resolve(again, after.people, after.aliases).first().person_id == "W"

    back, report = merging.unmerge_people(after, spark.createDataFrame([("t", "L"), ("t", "W")], "tenant_id STRING, loser_id STRING"))
    assert owners(back.sources) == owners(before.sources)
    assert owners(back.interactions) == owners(back.chunks) == {"c:L": "L"}
    assert back.aliases.count() == 0
    assert back.people.where("merged_into_id is not null").count() == 0
    assert {r.loser_id: (r.accepted, r.restored_sources) for r in report.collect()} == {"L": (True, 1), "W": (False, 0)}


def test_refused_merges(spark):
    net = network(spark, [person("A"), person("B"), person("C"), person("D", into="A")], [])
    asked = merges(spark, ("A", "A"), ("A", "X"), ("X", "A"), ("A", "D"), ("D", "A"), ("A", "B"), ("C", "B"), ("B", "C"), ("C", "A"))
    got = {r.pos: (r.accepted, r.reason) for r in merging.judge_merges(net.people, asked).collect()}
    assert [got[i][0] for i in range(9)] == [False] * 5 + [True, False, False, True]
    assert got[0][1] == "cannot merge a person into themselves"
    assert got[2][1] == "winner not found" and got[1][1] == "loser not found"
    assert got[6][1] == got[7][1] == "winner or loser was merged away by an earlier merge"


def merge_in_order(people, sources, pairs):
    """Merges one after the other."""
    into = {p[0]: p[6] for p in people}
    sources, aliases = dict(sources), {}
    accepted = []
    for w, l in pairs:
        ok = w != l and w in into and l in into and into[w] is None and into[l] is None
        accepted.append(ok)
        if ok:
            for rid, pid in sources.items():
                if pid == l:
                    sources[rid] = w
                    aliases[rid] = (w, l)
            into[l] = w
    return into, sources, aliases, accepted


def test_random_merge_chains_equal_one_by_one(spark):
    rng = random.Random(4)
    for _ in range(4):
        ids = [f"p{i}" for i in range(12)]
        people = [person(i, into="p0" if i == "p11" else None) for i in ids]
        sources = [(f"r{i}", rng.choice(ids[:11])) for i in range(30)]
        pairs = [(rng.choice(ids + ["zz"]), rng.choice(ids)) for _ in range(14)]
        into, owned, aliases, accepted = merge_in_order(people, sources, pairs)
        after, verdicts = merging.merge_people(network(spark, people, sources), merges(spark, *pairs))
        assert [v.accepted for v in sorted(verdicts.collect(), key=lambda v: v.pos)] == accepted
        assert owners(after.sources) == owned
        assert {p.id: p.merged_into_id for p in after.people.collect()} == into
        assert {a.source_record_id: (a.person_id, a.merged_from_id) for a in after.aliases.collect()} == aliases


def test_unmerging_in_reverse_order_is_the_identity(spark):
    people = [person("A"), person("B"), person("C"), person("D")]
    sources = [("a", "A"), ("b", "B"), ("c", "C"), ("d1", "D"), ("d2", "D")]
    start = network(spark, people, sources, sources, sources)
    after, _ = merging.merge_people(start, merges(spark, ("A", "B"), ("C", "D")))
    back, _ = merging.unmerge_people(after, spark.createDataFrame([("t", "B"), ("t", "D")], "tenant_id STRING, loser_id STRING"))
    assert owners(back.sources) == owners(back.interactions) == owners(back.chunks) == dict(sources)
    assert back.aliases.count() == 0


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("t", "contacts", "r1", "p", "{}", None)], schemas.PERSON_SOURCES)
    new = spark.createDataFrame(
        [("t", "contacts", "r1", "q", "{}", 0.9, 1), ("t", "contacts", "r1", "s", "{}", 0.8, 2), ("t", "contacts", "r2", "u", None, None, 3)],
        schemas.PERSON_SOURCES + ", pos INT",
    )
    once = keyed.upsert_sources(old, new)
    twice = keyed.upsert_sources(once, new)
    assert owners(once) == owners(twice) == {"r1": "s", "r2": "u"}
    assert once.count() == twice.count() == 2


def test_deletions_take_ids_literally(spark):
    rows = [("m_1#a@x", "m_1"), ("mx1#a@x", "mx1"), ("m%#a@x", "m%"), ("m_1#b@x", "m_1")]
    interactions = spark.createDataFrame([("t", "gmail", r, e, "p", "email", None, "s", None) for r, e in rows], schemas.INTERACTIONS)
    chunks = spark.createDataFrame([("t", "gmail", r, e, "h", "p", "x", None) for r, e in rows], schemas.CHUNKS)
    gone = spark.createDataFrame([("t", "gmail", "m_1"), ("t", "gmail", "m%"), ("t", "calendar", "mx1")], "tenant_id STRING, source_type STRING, external_id STRING")
    marked, kept = keyed.apply_deletions(interactions, chunks, gone, F.lit("2024-01-01").cast("timestamp"))
    assert {r.source_record_id for r in marked.where("deleted_at is null").collect()} == {"mx1#a@x"}
    assert marked.count() == 4
    assert {r.source_record_id for r in kept.collect()} == {"mx1#a@x"}
    back = keyed.upsert_interactions(marked, marked.withColumn("pos", F.lit(1)))
    assert back.where("deleted_at is not null").count() == 0


def test_unchanged_and_absent(spark):
    chunks = spark.createDataFrame([("t", "gmail", "r1", "r1", "h", "p", "x", None)], schemas.CHUNKS).withColumn("content_hash", F.sha2(F.lit("same"), 256))
    pending = spark.createDataFrame([("t", "r1", "same", 1), ("t", "r1", "changed", 2), ("t", "r2", " \t", 3), ("t", "r3", "twice", 4), ("t", "r3", "twice", 5)], "tenant_id STRING, source_record_id STRING, text STRING, pos INT")
    fresh, unchanged = keyed.split_unchanged(pending, chunks)
    assert {r.pos for r in fresh.collect()} == {2, 4, 5}
    assert {r.pos for r in unchanged.collect()} == {1}
    assert {r.pos for r in keyed.insert_absent(chunks, fresh, schemas.CHUNK_KEY, "pos").collect()} == {2, 4}
