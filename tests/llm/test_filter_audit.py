"""The filter audit over files that arrive in any order, against SQL over the whole table."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from kinweave.llm import filter_audit as fa
from kinweave.llm.oracle import ORACLE

WORDS = [f"w{n}" for n in range(400)]
TEXTS = [None, "", "  ", "a" * 30, "ONE TWO " * 200, "x|y " + " ".join(WORDS), " ".join(WORDS[:99]), " ".join(WORDS[:100])]
TEXTS += [" ".join(WORDS[:80] + WORDS[:20]), " ".join(WORDS[:79] + WORDS[:21]), "É" * 9 + "A", "É" * 8 + "AB", "w\x1cw w " * 120, "hot text"]
TEXTS += [" ".join(WORDS) + " " + "Long Text " * 30_000]


def table(rng, n):
    ids = [rng.choice([*range(n), None]) for _ in range(n)]
    texts = [rng.choice([*TEXTS, "hot text", "hot text", "hot text"]) if rng.random() < 0.8 else f"single {rng.random()}" for _ in range(n)]
    langs = [rng.choice(["en", "de", None, ""]) for _ in range(n)]
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string())})


def labels(rng, n):
    rows = [(rng.choice([*range(n), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(n)]
    return pa.table({c: pa.array(list(v), pa.int64()) for c, v in zip(("doc_id", "quality", "toxic"), zip(*rows, strict=True), strict=True)})


def stated(docs, told):
    db = duckdb.connect()
    db.register("documents", docs)
    db.register("labels", told)
    out = db.execute(ORACLE["op13_filter_audit"])
    return [c[0] for c in out.description], sorted(out.fetchall())


@pytest.mark.parametrize("order", ["ascending", "descending", "mixed"])
def test_smaller_ids_may_come_late(spark, tmp_path, order):
    rng = random.Random(order)
    docs = table(rng, 160)
    if order != "mixed":
        docs = docs.sort_by([("doc_id", order)])
    for n in range(5):
        pq.write_table(docs.slice(n * 40, 40).append_column("mask", pa.array(range(len(docs.slice(n * 40, 40))))), tmp_path / f"part-{n}.parquet")
    told = labels(rng, 160)
    columns, want = stated(docs, told)
    known = spark.createDataFrame([tuple(r.values()) for r in told.to_pylist()], "doc_id long, quality long, toxic long")
    got = fa.effects(fa.counters(spark, str(tmp_path), known, batches=5))
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(columns).collect())) == want


def test_counters_move_when_a_smaller_id_arrives(spark, tmp_path):
    for n, rows in enumerate(([(9, "t", "en")], [(5, "t", "de"), (7, "t", "en"), (5, "t", "de")], [(5, "t", "en"), (None, "t", "en")])):
        ids, texts, langs = zip(*rows, strict=True)
        pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": list(texts), "lang": list(langs)}), tmp_path / f"part-{n}.parquet")
    none = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    got = {(r.part, bool(r.mask & 16)): r.n for r in fa.counters(spark, str(tmp_path), none, batches=3).collect()}
    assert got == {("en", True): 2, ("de", False): 2, ("en", False): 2}


def test_empty_table(spark, tmp_path):
    docs = table(random.Random(1), 5).slice(0, 0)
    pq.write_table(docs, tmp_path / "part-0.parquet")
    none = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    assert fa.report(spark, str(tmp_path), none).isEmpty()


def test_masks_of_single_texts():
    masks = fa.own_masks(pa.array(TEXTS).slice(1)).tolist()
    for text, mask in zip(TEXTS[1:], masks, strict=True):
        words = (text or "").encode().split()
        fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in text or "") > 10 * len(text or ""), any(c in fa.MARKS for c in text or ""))
        assert mask == sum(1 << bit for bit, f in enumerate(fails) if f), text[:30]
