from __future__ import annotations

import html
import re
import time
from itertools import product

import numpy as np
import pytest

from kinweave.llm import itq, templates
from tests.llm import plain

SMALL = "/root/testdata/sf0.001"


def test_pages_keep_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in templates.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if b else "", b)).split()) for b in re.split(r"</?(?:h1|p)>", article)]
        assert got[r.page_id].text.replace(" ", "") == "\n".join(b for b in blocks if b).replace(" ", "")
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_repeated_parts_of_a_host_go_by_count_alone(spark):
    rows = []
    for k in range(60):
        tip = f"<div class=tip{''}>Tip {k % 3}</div>" if k else "<div class=tip>Only here</div>"
        rows.append((k, "http://h.example/x", f"<body><div class=top>Welcome <b>all</b></div>{tip}<div class=story><p>Own {k} text<p>More {k}</div></body>"))
    rows.append((100, "http://other.example/", "<body><div class=top>Welcome <b>all</b></div><div class=story><p>Alone</p></div>"))
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in templates.extract(df).collect()}
    assert got[0] == "Own 0 text\nMore 0"
    assert all(got[k] == f"Own {k} text\nMore {k}" for k in range(60))
    assert got[100].endswith("Alone")


def test_slots_spare_article_lists_copies_and_large_hosts(spark):
    rows = []
    for k in range(60):
        menu = "".join(f"<li>Menu {m}</li>" for m in range(12))
        rows.append((k, "http://menus.example/", f"<nav><ul>{menu}</ul></nav><article><p>Text {k}</p><ul><li>Item {k}</li></ul></article>"))
        rows.append((100 + k, "http://copied.example/", f"<div class=tip>Tip {k % 3}</div><article><p>Same words</p></article>" if k < 50 else f"<article><p>Other {k}</p></article>"))
        rows.append((200 + k, "http://lists.example/", f"<article><p>P {k}</p><ol><li>Step {k if k % 10 == 0 else k % 4}</li></ol></article>"))
        rows.append((300 + k, "http://own.example/", f"<div class=lot>Own {k}</div>"))
        for h in range(3):
            rows.append((400 + 100 * h + k, f"http://boxes{h}.example/", f"<div class=box>Box {k % 3}</div><p>Text {k}</p>"))
    rows.append((900, "http://few.example/", "<div class=box>Box 9</div><p>Few</p>"))
    got = {r.page_id: r.text for r in templates.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for k in range(60):
        assert got[k] == f"Text {k}\nItem {k}"
        assert got[100 + k] == ("Same words" if k < 50 else f"Other {k}")
        assert got[200 + k] == f"P {k}\nStep {k if k % 10 == 0 else k % 4}"
        assert got[300 + k] == f"Own {k}"
        assert got[400 + k] == f"Text {k}"
    assert got[900] == "Few"


@pytest.mark.parametrize(
    "source",
    [
        "<html class='menu-closed'><body class='no-sidebar'><p>Text</p><div class='ad'>Buy</div></body></html>",
        "<html class='menu'><body class='sidebar comments'><p>Text</p></body></html>",
        "<article class='post has-comments'><p>Text</p><div class='post comments'>Me too</div></article>",
        "<main class='widget'>Text</main>",
        "<div class='content with-sidebar'><p>Text</p></div><div id='comments'>Me too</div>",
        "<div class='sidebar'><div id='related'><article>Text</article></div></div>",
        "<body><div class='article-header'>Text</div></body>",
        "<article><div class='header'>Text</div></article><div class='header'>Site</div>",
    ],
)
def test_cues_are_whole_classes_and_spare_the_article(source):
    assert templates.text_of(source) == "Text"


@pytest.mark.parametrize(
    "source",
    [
        "<form action='.'><nav>n</nav><main><p>Text</p></main></form>",
        "<form><div><h1>Text</h1></div></form>",
        "<article><p>Text</p></article><section class='comments'><article>Me too</article></section>",
        "<article><p>Text</p><section class='comments'><article>Me too</article></section></article><form>Send</form>",
        "<main><div class='widget'><article>Text</article></div></main>",
        "<p title='a > b' class=x>Text</p>",
    ],
)
def test_forms_around_pages_and_comments_as_articles(source):
    assert templates.text_of(source) == "Text"


@pytest.mark.parametrize("piece", ["<a href=\"x' ", "<a ", "<p class='a><b>x", "<a \"", "<!-", "</a", "<a b='\""])
def test_broken_markup_takes_linear_time(piece):
    start = time.monotonic()
    templates.text_of(piece * (1_000_000 // len(piece)) if "<p" not in piece else piece * 1_001 + "'" + piece * 100_000)
    assert time.monotonic() - start < 30
    assert templates.text_of("a <b \"c <i>d</i>") == 'a <b "c d'


def test_odd_pages(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    rows = [
        (1, None, None), (2, "x", ""), (3, "http://a/", "plain &amp; text &nbsp; a < b"), (4, "http://a/", deep), (None, "http://a/", "<p>x"), (None, "http://a/", "<p>x"),
        (5, "http://a/", "<article><header><h1>T</h1></header><p>a<br>b</p><ul><li>one<li>two</ul><form>f</form><div class='comments'>c</div></article><p>out"),
        (6, "http://a/", "<script>var a='<p>no</p>'</script><style>x</style><nav>n</nav><p>" + "w " * 100_000),
    ]
    df = spark.createDataFrame([(*r, "own") for r in rows], "page_id bigint, url string, html string, text string")
    out = templates.extract(df).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(rows)
    assert (got[1], got[2], got[3], got[4], got[None]) == ("", "", "plain & text a < b", "deep", "x")
    assert got[5] == "T\na b\none\ntwo"
    assert len(got[6]) == 199_999
    assert templates.extract(df.where("false")).isEmpty()


def links_of(rows, threshold):
    sound = [r for r in rows if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    unit = {k: np.array(r[1], dtype=float) / np.linalg.norm(np.array(r[1], dtype=float)) for k, r in enumerate(sound)}
    return [(sound[a][0], sound[b][0]) for a in unit for b in unit if a < b and sound[a][2] == sound[b][2] and unit[a] @ unit[b] >= threshold]


@pytest.mark.parametrize("group", [0, 700])
def test_vectors_recall_and_components(spark, group):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, [float(np.float32(x)) for x in r.embedding], r.label) for r in table.collect()]
    width = len(rows[0][1])
    odd = [None, [], [0.0] * width, [float("nan")] * width, [1.0] * (width - 1) + [None], [float("inf")] * width, rows[0][1]]
    rows += [(100_000 + k, v, None if k == 6 else 0) for k, v in enumerate(odd)]
    rows += [(110_000 + k, rows[1][1], rows[1][2]) for k in range(5)]
    rng = np.random.default_rng(0)
    centre = rng.normal(size=width)
    rows += [(120_000 + k, [float(np.float32(x)) for x in centre + 0.2 * rng.normal(size=width)], 77) for k in range(group)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: r for r in itq.near_copies(df).collect()}
    links = links_of(rows, itq.THRESHOLD)
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert len(got) == len(rows)
    assert all(got[i].n_links <= n[i] for i in n)
    assert sum(got[i].n_links for i in n) >= 0.95 * sum(n.values())
    want = plain.components(n, links)
    assert np.mean([got[i].component_id == want[i] for i in n]) > 0.99
    assert all(got[100_000 + k].component_id == 100_000 + k for k in range(7))
    assert itq.near_copies(df.where("false")).isEmpty()


def test_vectors_of_every_length_are_compared(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=64)], 0) for k in range(20)]
    short = [float(np.float32(x)) for x in rng.normal(size=32)]
    rows += [(100, short, 0), (101, short, 0), (102, [2 * x for x in short], 0), (103, short, 1), (104, [1.0, 1.0], 0), (105, [1.0, 1.01], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in itq.near_copies(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    assert [got[k] for k in (100, 101, 102, 103)] == [(2, 100)] * 3 + [(0, 103)]
    assert got[104] == got[105] == (1, 104)
    assert all(got[k] == (0, k) for k in range(20))
    assert itq.fit(rng.normal(size=(3, 8)), 2).shape == (8, 16)


def test_doubles_keep_their_range_and_digits(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=32)
    rows = [(1, (base * 1e300).tolist(), 0), (2, (base * 1e-50).tolist(), 0), (3, (base * 1e-300).tolist(), 0), (4, base.tolist(), 0)]
    # just above and just below the threshold, closer than floats can tell
    turn = rng.normal(size=32)
    turn -= base * (turn @ base) / (base @ base)
    turn /= np.linalg.norm(turn) / np.linalg.norm(base)
    for k, cosine in enumerate((itq.THRESHOLD + 1e-10, itq.THRESHOLD - 1e-10)):
        rows += [(10 + 10 * k, base.tolist(), 1 + k), (11 + 10 * k, (base * cosine + turn * np.sqrt(1 - cosine**2)).tolist(), 1 + k)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in itq.near_copies(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert [got[k] for k in (1, 2, 3, 4)] == [(3, 1)] * 4
    assert got[20] == (0, 20) and got[21] == (0, 21)
    assert got[10] == (1, 10) and got[11] == (1, 10)


def test_recall_on_planted_near_copies(spark):
    """14,000 vectors of two lengths and five labels: a third near copies of others, and one narrow group of each length."""
    rng = np.random.default_rng(5)
    rows = []
    for width, start in ((64, 0), (16, 100_000)):
        x = rng.normal(size=(4_000, width)).astype(np.float32)
        near = x[:2_000] + rng.uniform(0.1, 0.4, size=(2_000, 1)) * rng.normal(size=(2_000, width))
        group = rng.normal(size=width) + 0.25 * rng.normal(size=(1_000, width))
        every = np.concatenate([x, near.astype(np.float32), group.astype(np.float32)])
        labels = np.concatenate([np.arange(4_000) % 4, np.arange(2_000) % 4, np.full(1_000, 4)])
        rows += [(start + k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(every, labels, strict=True))]
    got = {r.vec_id: r for r in itq.near_copies(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    for start, narrow in product((0, 100_000), (False, True)):
        own = [r for r in rows if start <= r[0] < start + 50_000 and (r[2] == 4) == narrow]
        unit = np.array([r[1] for r in own])
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        label = np.array([r[2] for r in own])
        like = (unit @ unit.T >= itq.THRESHOLD) & (label[:, None] == label) & ~np.eye(len(own), dtype=bool)
        n = like.sum(axis=1)
        links = np.array([got[r[0]].n_links for r in own])
        assert n.sum() > 2_000 and (links <= n).all() and links.sum() >= 0.97 * n.sum()
