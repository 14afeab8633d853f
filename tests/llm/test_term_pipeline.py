"""Pipelined term search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import pytest

from kinweave.llm import term_pipeline as tp

ODD = [
    (1, None), (2, ""), (3, " .,\t"), (4, "One, two ONE"), (5, "two one one"), (5, "two one one"), (5, "two one three"),
    (None, "one two"), (None, "one two"), (6, "É é É ça 漢字 x1"), (7, "common " * 5_000 + "rare"), (-8, "common rare"),
]
ASKED = [(1, "one TWO two"), (1, "one TWO two"), (2, None), (3, "..."), (4, "é É rare"), (None, "common"), (5, "unseen"), (6, "a b c d e f g h common")]


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(docs, items, best):
    full = [(i, Counter(w), len(w)) for i, t in docs if (w := terms(t))]
    count, total = len(full), sum(n for _, _, n in full)
    df = Counter(t for _, tf, _ in full for t in tf)
    out = []
    for item, text in items:
        scores = []
        for doc, tf, n in full:
            m, score = 100 - 50 + (50 * n * count) // total, 0
            for t in set(terms(text)) & set(tf):
                w = math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * tf[t]) // (1000 * tf[t] + 20 * m))
            if score > 0:
                scores.append((-score, doc is not None, doc or 0))
        out += [(item, k + 1, doc if known else None, -s) for k, (s, known, doc) in enumerate(sorted(scores)[:best])]
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


@pytest.mark.parametrize(("block", "bundle", "wanted", "best"), [(4_096, 256, 1_000_000, 50), (3, 2, 0, 4), (2, 1, 5, 1)])
def test_equals_scoring_everything(spark, monkeypatch, block, bundle, wanted, best):
    for name, value in (("BLOCK_DOCS", block), ("BUNDLE", bundle), ("WANTED", wanted)):
        monkeypatch.setattr(tp, name, value)
    rng = random.Random(11)
    words = [f"w{int(rng.expovariate(0.08))}" for _ in range(4_000)] + ["a", "b", "c", "d", "common"] * 50
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(90)]
    docs = ODD + [(100 + n // 2, t) for n, t in enumerate(texts)] + [(300 + n, texts[0]) for n in range(9)]
    items = ASKED + [(10 + n, " ".join(rng.choices(words, k=12))) for n in range(6)]
    d = spark.createDataFrame([(i, t, "own") for i, t in docs], "doc_id long, text string, term string").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, bundle int").coalesce(1)
    got = tp.search(d, q, best)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert ordered(map(tuple, got.collect())) == ordered(plain(docs, items, best))


def test_empty_tables(spark):
    d = spark.createDataFrame(ODD, "doc_id long, text string")
    q = spark.createDataFrame(ASKED, "item_id long, text string")
    for docs, items in ((d.where("false"), q), (d, q.where("false")), (d.where("doc_id = 2"), q)):
        assert tp.search(docs, items).isEmpty()
