"""Main text of web pages by site template removal.

Every block element of a page that does not go by its tag or class gives a slot (the tags and classes of
its whole path, its own id and role) and a hash of its subtree's text and tags. Spark counts on how many
distinct contents of each host a subtree stands, where a page's content is its article and main elements, or
all of it where there are none: copies of a page count once, so they keep their text. Two things follow:

* A subtree on at least half of a host's contents is template there and deleted.
* A slot whose subtrees nearly all stand on several of them (a share, so that the size of the input does not
  decide) holds template parts, and is deleted with whatever it holds, also a variant seen once. A host with
  few contents borrows the counts of all hosts. Slots inside an article or main element, or around one, are
  never deleted as such: there only what repeats itself goes.

Elements that HTML defines as no content (scripts, forms, menus ...) go by their tag, and those with a whole
class, id or role that says so by that, as reader comments never repeat; but never the page, an article or
main element, or one around it, whatever its class. Within what is left, the article or main
elements are the text, or the whole body where there are none.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import slices
from kinweave.session import cut_lineage

#: Least share of a host's pages, and pages, for a subtree; of a slot's subtrees that repeat, and subtrees.
PAGE_SHARE = 0.5
LEAST_PAGES = 10
SLOT_SHARE = 0.8
LEAST_SLOTS = 20
#: Least share of a host's pages at which a subtree repeats (and at least two of them).
REPEAT_SHARE = 0.01

# Element names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
_NO_CONTENT = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form frame frameset head header iframe input legend link map math "
    "menu meta nav noembed noframes noscript object option optgroup output progress script select style svg template textarea title "
    "video".split()
)
_ARTICLE = ("article", "main")
_NEVER_CUED = frozenset(["html", "body", *_ARTICLE])
#: Tags and classes that are an article's own headline and end inside it.
_ARTICLE_PARTS = frozenset(["header", "footer"])
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol "
    "p pre section table ul".split()
)
_ENDS_ITEM = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "option": {"option"},
}
#: Whole classes, ids and roles that name no content; a part of one (no-sidebar, article-header) says nothing.
_CUES = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent "
    "contentinfo cookie cookies disclaimer disqus footer form header menu modal nav navbar navigation newsletter notice notices "
    "popup promo promoted related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar "
    "widget "
    "comment-body comment-content comment-form comment-list comments-area cookie-banner cookie-consent cookie-notice main-menu main-nav "
    "nav-bar nav-menu related-articles related-posts share-buttons site-footer site-header social-share".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)", re.S
)
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


class Element:
    __slots__ = ("tag", "slot", "path", "cued", "parts", "parent", "digest", "gone", "inside", "holds", "under", "wraps")

    def __init__(self, tag: str, marks: list[str], parent: Element | None):
        self.tag, self.parent = tag, parent
        self.parts: list = []  # texts and elements in order
        cues = {w for m in marks for w in m.partition("=")[2].split()} & _CUES
        self.cued = 0 if not cues or tag in _NEVER_CUED else 1 if cues <= _ARTICLE_PARTS else 2
        self.under = self.cued == 2 or parent is not None and parent.under  # in something that goes by its class
        self.wraps = False  # a form around a headline or an article
        above = parent.path if parent else 0
        self.slot = _hash(f"{above}/{tag}{''.join(' ' + m for m in marks)}")
        self.path = above if tag in _INLINE else _hash(f"{above}/{tag}{''.join(' ' + m for m in marks if m.startswith('class='))}")
        self.digest = 0
        self.gone = False  # by its tag or class
        self.inside = self.holds = False  # stands in an article or main element, is or holds one
        if tag in _ARTICLE:
            at = self
            while at is not None and not at.holds:
                at.holds = True
                at = at.parent


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _tag_end(source: str, at: int, known: dict) -> int:
    """Where the > of a tag is, past its quoted values; -1 without one. ``known`` holds that place for each
    quote passed, and from where on a character is missing, so that a page takes linear time however broken it is."""
    passed, end = [], -1
    while at < known.get("", len(source)):
        stop = _STOP.search(source, at)
        if stop is None:
            known[""] = at
            break
        mark = stop.start()
        if stop[0] == ">" or mark in known:
            end = known.get(mark, mark)
            break
        passed.append(mark)
        close = source.find(stop[0], mark + 1) if mark < known.get(stop[0], len(source)) else -1
        if close < 0:
            known[stop[0]] = min(mark, known.get(stop[0], mark))
            break
        at = close + 1
    known.update(dict.fromkeys(passed, end))
    return end


def parse(source: str) -> Element:
    """The element tree; forgiving of missing and surplus end tags."""
    root = at = Element("", [], None)
    place = looked = 0
    known: dict = {}
    while True:
        token = _TOKEN.search(source, looked)
        stop = _tag_end(source, token.end(), known) if token and token[2] else 0
        if stop < 0:  # no tag: its text goes on
            looked = token.start() + 1
            continue
        if token is None:
            at.parts.append(source[place:])
            return root
        if token.start() > place:
            at.parts.append(source[place : token.start()])
        place = looked = stop + 1 if token[2] else token.end()
        if token[1]:
            tag = token[1].lower()
            end = at
            while end.parent is not None and end.tag != tag:
                end = end.parent
            if end.parent is not None and (tag not in _INLINE or _same_block(at, end)):
                at = end.parent
        elif token[2]:
            tag = token[2].lower()
            if tag in _ENDS_P:
                at = _ended(at, {"p"}, stop=_ENDS_P)
            elif tag in _ENDS_ITEM:
                at = _ended(at, _ENDS_ITEM[tag], stop={"ul", "ol", "dl", "table", "select", "menu"})
            attributes = source[token.end() : stop]
            marks = sorted(f"{m[1].lower()}={(m[2] or m[3] or m[4] or '').lower()}" for m in _ATTRIBUTE.finditer(attributes)) if attributes else []
            child = Element(tag, marks, at)
            at.parts.append(child)
            if tag == "article" and not child.under:
                root.wraps = True  # the page has an article that nothing takes away
            if tag == "h1" or tag in _ARTICLE:
                _wrap(at)
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, place)
                place = looked = end.end() if end else len(source)
            elif tag not in _VOID and not (attributes and attributes.endswith("/")):
                at = child


def _wrap(e: Element | None) -> None:
    while e is not None and not (e.tag == "form" and e.wraps):
        e.wraps |= e.tag == "form"
        e = e.parent


def _same_block(at: Element, end: Element) -> bool:
    while at is not end:
        if at.tag not in _INLINE:
            return False
        at = at.parent
    return True


def _ended(at: Element, tags: set[str], stop) -> Element:
    """Where an element goes that ends the open ``tags`` around it, up to the next of ``stop``."""
    out, near = at, at
    while near.parent is not None:
        if near.tag in tags:
            out = near.parent
        elif near.tag in stop:
            break
        near = near.parent
    return out


def _no_content(e: Element, in_article: bool, other: bool) -> bool:
    """A class takes what holds an article only where the page has ``other`` articles; a form around the page stays."""
    cued = e.cued > in_article and not (e.holds and not (other and e.cued == 2))
    return cued or e.tag in _NO_CONTENT and not e.wraps and not (in_article and e.tag in _ARTICLE_PARTS)


def digest(e: Element, other: bool | None = None) -> int:
    """Hash of a subtree's tags and texts, kept in every element of it, without what goes by tag or class."""
    other = e.wraps if other is None else other
    parts = [e.tag]
    inside = e.inside or e.tag in _ARTICLE
    for p in e.parts:
        if isinstance(p, str):
            parts.append(" ".join(p.split()))
            continue
        p.inside = inside
        p.gone = p.tag in _RAW or _no_content(p, inside, other)
        if not p.gone:
            parts.append(str(digest(p, other)))
    e.digest = _hash("\x1f".join(parts))
    return e.digest


def _elements(root: Element) -> Iterator[Element]:
    """Block elements that do not go by tag or class, outermost first, in page order."""
    todo = [root]
    while todo:
        e = todo.pop()
        if e.tag and e.tag not in _INLINE and e.tag not in _RAW and e.tag not in ("html", "body", "head") and e.tag not in _VOID:
            yield e
        todo.extend(p for p in reversed(e.parts) if not isinstance(p, str) and not p.gone)


def _content(root: Element, elements: list[Element]) -> int:
    """Hash of the outermost article and main elements, or of the whole page where there are none."""
    own = [str(e.digest) for e in elements if e.tag in _ARTICLE and not e.inside]
    return _hash("\x1f".join(own)) if own else root.digest


def text_of(source: str | None, slots: frozenset[int] = frozenset(), subtrees: frozenset[int] = frozenset()) -> str:
    """The page's text without the deleted slots and subtrees: one line per block."""
    root = parse(source or "")
    digest(root)
    whole: list[str] = []
    article: list[str] = []
    current: list[str] = []
    inside = [0]

    def close() -> None:
        line = " ".join(html.unescape("".join(current)).split())
        current.clear()
        if line:
            whole.append(line)
            if inside[0]:
                article.append(line)

    def walk(e: Element) -> None:
        for p in e.parts:
            if isinstance(p, str):
                current.append(p)
                continue
            block = p.tag not in _INLINE
            if p.gone or block and (p.digest in subtrees or p.slot in slots and not p.inside and not p.holds):
                if block:
                    close()
                continue
            if p.tag == "br":
                current.append(" ")
            if block:
                close()
            inside[0] += p.tag in _ARTICLE
            walk(p)
            if block:
                close()
            inside[0] -= p.tag in _ARTICLE

    walk(root)
    close()
    return "\n".join(article or whole)


def host_of(url: str) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(F.col(url).cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def _count_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _room()
    for batch in slices(batches, 1, 1 << 20):
        hosts, contents, slots, subtrees = [], [], [], []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root = parse(source or "")
            digest(root)
            elements = list(_elements(root))
            # slot 0 is any place, and subtree 0 the page itself
            own = {(0, e.digest) for e in elements} | {(e.slot, e.digest) for e in elements if not e.inside and not e.holds} | {(0, 0)}
            hosts += [host] * len(own)
            contents += [_content(root, elements)] * len(own)
            slots += [s for s, _ in own]
            subtrees += [d for _, d in own]
        yield pa.RecordBatch.from_pydict(
            {"host": hosts, "content": pa.array(contents, pa.int64()), "slot": pa.array(slots, pa.int64()), "subtree": pa.array(subtrees, pa.int64())}
        )


def _room() -> None:
    """Nested markup is walked by plain recursion, which needs heap and no stack of the machine."""
    if sys.getrecursionlimit() < 1_000_000:
        sys.setrecursionlimit(1_000_000)


def templates(pages: DataFrame, page_html: str = "html", url: str = "url") -> DataFrame:
    """For each host the slots and the subtrees to delete: host, slots array<bigint>, subtrees array<bigint>."""
    seen = pages.select(host_of(url).alias("host"), F.col(page_html).cast("string").alias("html"))
    parts = seen.mapInArrow(_count_parts, "host string, content bigint, slot bigint, subtree bigint").distinct()
    counts = cut_lineage(parts.groupBy("host", "slot", "subtree").agg(F.count("*").alias("n")))
    sizes = counts.where("slot = 0 and subtree = 0").select("host", F.col("n").alias("pages"))
    often = counts.where(f"slot = 0 and subtree <> 0 and n >= {LEAST_PAGES}").join(sizes, "host").where(F.col("n") >= PAGE_SHARE * F.col("pages"))
    subtrees = often.groupBy("host").agg(F.collect_set("subtree").alias("subtrees"))  # at most 1 / PAGE_SHARE times a page's elements
    repeats = F.col("n") >= F.greatest(F.lit(2.0), REPEAT_SHARE * F.col("pages"))
    slots = counts.where("slot <> 0").join(sizes, "host").groupBy("host", "pages", "slot")
    slots = slots.agg(F.sum("n").alias("n"), F.sum(F.when(repeats, F.col("n")).otherwise(0)).alias("again"))
    every = slots.groupBy("slot").agg(F.sum("n").alias("all_n"), F.sum("again").alias("all_again"), F.count("*").alias("hosts"))
    judged = slots.join(every, "slot")
    own = (F.col("n") >= LEAST_SLOTS) & (F.col("again") >= SLOT_SHARE * F.col("n"))
    few = F.col("pages") < LEAST_SLOTS
    borrowed = few & (F.col("hosts") > 1) & (F.col("all_n") >= LEAST_SLOTS) & (F.col("all_again") >= SLOT_SHARE * F.col("all_n"))
    gone = judged.where(own | borrowed).groupBy("host").agg(F.collect_set("slot").alias("slots"))  # slots of one site's markup
    return sizes.select("host").join(gone, "host", "left").join(subtrees, "host", "left")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _room()
    for batch in slices(batches, 2, 1 << 20):
        texts = [
            text_of(source, frozenset(slots or ()), frozenset(subtrees or ()))
            for source, slots, subtrees in zip(*[batch.column(k).to_pylist() for k in (2, 3, 4)], strict=True)
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, page: str = "page_id", url: str = "url", page_html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page. A null or empty page has an empty text; pages whose
    address has no host count as one host. Repeated pages are each extracted."""
    gone = cut_lineage(templates(pages, page_html, url))  # small beside the pages, so Spark broadcasts it where it is
    own = pages.select(F.col(page).alias("page_id"), F.col(url).alias("url"), F.col(page_html).cast("string").alias("html"), host_of(url).alias("host"))
    joined = own.join(gone.select(F.col("host").alias("gone_host"), "slots", "subtrees"), F.col("host") == F.col("gone_host"), "left")
    joined = joined.select("page_id", "url", "html", "slots", "subtrees")
    schema = f"page_id {dict(joined.dtypes)['page_id']}, url {dict(joined.dtypes)['url']}, text string"
    return joined.mapInArrow(_extract, schema).withColumn("n_chars", F.length("text").cast("bigint"))
