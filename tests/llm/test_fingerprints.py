"""Order MinHash against a plain version that ranks all items anew for every point."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from kinweave.llm import order_minhash as om

SMALL = "/root/testdata/sf0.001"


APART = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff"
LETTER = f"[^ \\t-\\r{APART}]{{1,16}}|[{APART}]"


def _xx(*values, seed=42):
    """Spark's xxhash64: bytes, 64-bit or (as a pair with its width) 32-bit integers, one after the other."""
    for v in values:
        data = v if isinstance(v, bytes) else v[0].to_bytes(4, "little") if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed


def signature(text, k=om.KMER, sketches=om.SKETCHES, size=om.TUPLE):
    letters = [w.encode() for w in re.findall(LETTER, text or "")]
    if not letters:
        return []
    seen, items = Counter(), []
    for at in range(max(len(letters) - k, 0) + 1):
        h = _xx(*letters[at : at + k]) >> 33
        items.append((_xx(h, (seen[h],)) >> 33 if seen[h] else h, at + 1))
        seen[h] += 1
    out, least = [], min(size, len(items))
    hashes, places = np.array(items, dtype=np.int64).T
    for j in range(sketches):
        point = (j << 31) // sketches
        ranks = (hashes - point) % (1 << 31) << 32 | places
        lowest = np.sort(np.partition(ranks, least - 1)[:least])
        ranked = [(((int(r) >> 32) + point) % (1 << 31), int(r) & 0xFFFFFFFF) for r in lowest]
        picks = sorted((place, h) for h, place in (ranked[t % len(ranked)] for t in range(size)))
        out.append(_xx(*[h for _, h in picks]) >> 33)
    return out


def alike(a, b):
    return sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b)) if a or b else 1.0


TEXTS = [
    None, "", "a", "short", "two words", "exactly16letters", "exactly17letters.", "é" * 30, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "the same words again and again " * 40, "zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich 漢字仮名交じり文",
    "the same words again and again " * 40, "x" * 20_000, " \t\n",
]


def test_fingerprints_equal_the_plain_version(spark):
    known = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(15).collect()]
    texts = TEXTS + known
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string").withColumn("_ITEM", F.lit("own"))
    for k, sketches, size in ((om.KMER, om.SKETCHES, om.TUPLE), (3, 10, 3)):
        out = om.fingerprints(df, "text", "print", k, sketches, size)
        assert out.columns == ["n", "text", "_ITEM", "print"]
        for r in out.collect():
            assert r.print == signature(texts[r.n], k, sketches, size), (r.n, k)
    assert om.fingerprints(df.where("false"), "text", "print").isEmpty()


def test_likeness_follows_edits_and_order(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(3_000)]
    text = " ".join(words[:1_500])
    near, cut = text.replace(words[700], "changed"), len(text) // 2
    moved, other = f"{text[cut:]} {text[:cut]}", " ".join(words[1_500:])
    a, b, c, d = (signature(t) for t in (text, near, moved, other))
    assert alike(a, b) > 0.9 > alike(a, c) > 0.2 > alike(a, d)
    got = spark.createDataFrame([(a, b, c, d, [])], "a array<int>, b array<int>, c array<int>, d array<int>, e array<int>")
    row = got.select(*[om.likeness(F.col("a"), F.col(x)) for x in "abcde"], om.likeness(F.col("e"), F.col("e"))).first()
    assert list(row) == [1.0, alike(a, b), alike(a, c), alike(a, d), 0.0, 1.0]


def test_report_pairs_every_document_with_the_next_one(spark):
    known = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = [(-5 - n, t, None, None, n) for n, t in enumerate(TEXTS)] + [(10**15, "far", "en", "x", 3), (None, "no id", None, None, 5)] * 2
    docs = known.unionByName(spark.createDataFrame(odd, known.schema)).withColumn("TEXT_", F.lit(1)).withColumn("copy", F.lit(2))
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    prints = {t: signature(t) for t in {r.text for r in rows}}
    for r, after in zip(rows, rows[1:] + rows[:1], strict=True):
        own, late = r.text or "", after.text or ""
        q = len(own) // 4
        edited = own[: len(own) - q] + late[:q]
        a, b = prints[r.text], signature(edited)
        want.append((r.doc_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:08x}" for x in a), "".join(f"{x:08x}" for x in b), alike(a, b), alike(a, prints[after.text])))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    for frame in (docs, docs.repartition(7)):
        assert sorted(map(tuple, om.report(frame).collect()), key=key) == sorted(want, key=key)


def test_many_ranges_give_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(om, "ROWS_PER_RANGE", 1)
    monkeypatch.setattr(om, "QUANTILES", 8)
    rng = random.Random(5)
    ids = [rng.choice([rng.randrange(-50, 50), rng.randrange(-(1 << 62), 1 << 62)]) for _ in range(300)]
    df = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "doc_id long, text string")
    got = om.with_next(df, "doc_id", "text", lambda x: x.withColumn("fingerprint", F.array("text")))
    rows = sorted((i, f"text {n}") for n, i in enumerate(ids))
    want = sorted((*a, [a[1]], b[1], [b[1]]) for a, b in zip(rows, rows[1:] + rows[:1], strict=True))
    assert sorted(map(tuple, got.collect())) == want


def test_report_of_one_and_of_no_document(spark):
    one = spark.createDataFrame([(7, "abcdefgh")], "doc_id long, text string")
    row = om.report(one).first()
    assert (row.n_chars, row.near_next) == (8, 1.0) and row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert om.report(one.where("false")).isEmpty()
