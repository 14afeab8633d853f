"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans: strict ones per kind, checked (octets, Luhn, digits), and looser ones. Labelers vote
on each span (+1, -1, or 0 for no opinion): the checked pattern, a gazetteer of endings, prefixes and
ranges, the words before it, and what touches it. Expectation-maximisation over the counts of vote
patterns of the whole corpus estimates how reliable each labeler is and how likely each span is real; a
naive Bayes classifier over votes, length and separators is trained on those likelihoods and decides
about the looser spans. Strict spans that pass their check always stay.

Only counts of vote patterns reach the driver: at most kinds x 3**labelers x lengths x separators rows,
whatever the data.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce
from itertools import product
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.session import cut_lineage

KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
#: Kinds whose strict pattern makes a span that always stays.
STRICT = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "gazetteer", "context", "touch")
ACCEPT = 0.9
ROUNDS = 30
NEAR = 32
#: The weight of prior opinion against a kind's whole count, and that opinion: how often a labeler votes
#: against, nothing, for, on spans that are real; mirrored on others. Shares, so the size of a corpus decides nothing.
PRIOR = 0.05
OPINION = (0.5, 1.0, 2.0)
RUN = 64

# Patterns of the kinds. A run of name characters is tried from its start (or from the end
# of the match before) only, which gives the same matches without trying each of its characters.
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]{2,63}){1,4}",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
}
# What the labelers know. Each is a pattern on the span (gazetteer) or on the text before it.
_KNOWN = {
    "email": r"(?:\.|\x20?[\[(]dot[\])]\x20?)(?:com|org|net|edu|gov|io|info|biz|eu|uk|de|fr|es|it|nl|ch|at|us|ca|au|jp|in|br)$",
    "ip": r"^(?!0|127\.|255\.|2[4-5][0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^(?:\+(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1-6]|9[0-58])|\(?[2-9][0-9]{2})",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "iban": r"^(?:AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK)",
}
_FOR = {
    "email": "mail|contact|write|reach|@",
    "ip": "ip|address|host|server|addr",
    "card": "card|visa|mastercard|amex|credit|pay",
    "phone": "phone|tel|call|mobile|fax|cell|whatsapp",
    "ssn": "ssn|social security|tax id",
    "iban": "iban|account|bank",
}
_AGAINST = "isbn|issn|version|order|invoice|serial|sku|part no|hash|sha|doi|token|password|chapter|section|page"

_SPAN = "struct<kind:int,start:bigint,end:bigint,text:string,before:string,after:string>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though the body's own lambdas use it often."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(numbers: Column, levels: int = 2) -> Column:
    """Running sums of an array. Sums stay within runs of RUN, whose totals are added up the same way, so
    the work grows with the length and not with its square."""

    def summed(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)

    def run(a: Column, k: Column) -> Column:
        return F.slice(a, k * RUN + 1, RUN)

    def body(a: Column) -> Column:
        if levels == 0:
            return F.transform(a, lambda _, k: summed(F.slice(a, 1, k + 1)))
        runs = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / RUN).cast("int"))
        totals = _running(F.transform(runs, lambda k: summed(run(a, k))), levels - 1)

        def within(before: Column, k: Column) -> Column:
            return _let(run(a, k), lambda own: F.transform(own, lambda _, j: before + summed(F.slice(own, 1, j + 1))))

        sums = _let(totals, lambda t: F.flatten(F.transform(runs, lambda k: within(F.coalesce(F.get(t, k - 1), F.lit(0)), k))))
        return F.when(F.size(a) > 0, sums).otherwise(F.array().cast("array<bigint>"))

    return _let(numbers, body)


def _found(text: Column, kind: int, pattern: str) -> Column:
    """All matches of a pattern as spans, with a few characters around them; ends are exclusive code points."""
    none = F.array().cast(f"array<{_SPAN}>")

    def placed(pairs: Column) -> Column:
        lengths = F.transform(pairs, lambda p: (F.char_length(p["gap"]) + F.char_length(p["hit"])).cast("bigint"))

        def span(pair: Column, end: Column) -> Column:
            return F.struct(
                F.lit(kind).alias("kind"), (end - F.char_length(pair["hit"])).alias("start"), end.alias("end"), pair["hit"].alias("text"),
                F.lower(F.substring(pair["gap"], -NEAR, NEAR)).alias("before"), F.substring(pair["next"], 1, 1).alias("after"),
            )

        return F.zip_with(pairs, _running(lengths), span).cast(f"array<{_SPAN}>")

    def cut(both: Column) -> Column:
        hits, gaps = both["hits"], both["gaps"]
        return F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap"), F.slice(gaps, 2, F.size(hits)).alias("next"))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), _let(_let(both, cut), placed)).otherwise(none)


def _meets(taken: Column, span: Column) -> Column:
    """Whether a span overlaps one of an array of disjoint spans in order of their starts, by halving."""

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"] + 1) / 2).cast("int")
        below = F.get(taken, middle - 1)["start"] < span["end"]
        low = F.when((at["low"] < at["high"]) & below, middle).otherwise(at["low"])
        high = F.when((at["low"] < at["high"]) & ~below, middle - 1).otherwise(at["high"])
        return F.struct(low.alias("low"), high.alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(taken) + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("low"), F.size(taken).alias("high"))
    return F.coalesce(F.aggregate(steps, start, halve, lambda at: F.get(taken, at["low"] - 1)["end"] > span["start"]), F.lit(False))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _checked(span: Column) -> Column:
    """Whether a span of a strict pattern passes its kind's check."""
    digits = _digits(span["text"])
    return (
        F.when(span["kind"] == 1, F.forall(F.split(span["text"], r"\."), lambda p: p.rlike("^0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$|^0+$")))
        .when(span["kind"] == 2, F.length(digits).between(16, 19) & F.call_function("luhn_check", digits))
        .when(span["kind"] == 3, F.length(digits).between(8, 15))
        .otherwise(F.lit(True))
    )


def _by_kind(span: Column, patterns: dict[str, str], text: Column) -> Column:
    out = F.lit(False)
    for k, kind in reversed(list(enumerate(KINDS))):
        out = F.when(span["kind"] == k, text.rlike(patterns[kind])).otherwise(out)
    return out


def _judged(spans: Column, strict: bool) -> Column:
    """Spans with their votes, length class and separators, as one pattern number each."""

    def one(s: Column) -> Column:
        touched = s["before"].rlike("[a-z0-9_]$") | s["after"].rlike("[A-Za-z0-9_]")
        votes = [
            F.lit(2 if strict else 1),
            F.when(_by_kind(s, _KNOWN, s["text"]), 2).otherwise(0),
            F.when(_by_kind(s, _FOR, s["before"]), 2).when(s["before"].rlike(_AGAINST), 0).otherwise(1),
            F.when(touched, 0).otherwise(2),
        ]
        size = F.least(F.lit(3), F.floor(F.char_length(s["text"]) / 8)).cast("int")
        apart = F.when(s["text"].rlike(r"[\x20()]"), 2).when(s["text"].rlike("[.-]"), 1).otherwise(0)
        code = s["kind"]
        for vote in votes:
            code = code * 3 + vote
        code = (code * 4 + size) * 3 + apart
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(strict).alias("strict"), code.alias("code"))

    return F.transform(spans, one)


def spans_of(text: Column) -> tuple[Column, Column]:
    """(strict spans that pass their check, looser spans), each an array in kind and start order."""
    digit = text.rlike("[0-9]")
    none = F.array().cast(f"array<{_SPAN}>")
    guard = {"email": text.contains("@"), "ip": digit, "card": digit, "phone": text.contains("+")}
    strict = F.concat(*[F.when(guard[k], _found(text, KINDS.index(k), p)).otherwise(none) for k, p in _PATTERNS.items()])
    loose = F.concat(
        *[F.when(text.rlike(r"[\[(]at[\])]") if k == "email" else digit, _found(text, KINDS.index(k), p)).otherwise(none) for k, p in _LOOSE.items()]
    )
    return _judged(F.filter(strict, _checked), True), _judged(loose, False)


def _votes(code: int) -> tuple[int, tuple[int, ...], int, int]:
    apart, code = code % 3, code // 3
    size, code = code % 4, code // 4
    votes = []
    for _ in LABELERS:
        votes.append(code % 3 - 1)
        code //= 3
    return code, tuple(reversed(votes)), size, apart


def _shares(counts: dict[int, int]) -> dict[int, float]:
    """Each pattern's share of its kind, in an order of their own."""
    totals: dict[int, int] = defaultdict(int)
    for code, n in counts.items():
        totals[_votes(code)[0]] += n
    return {code: counts[code] / totals[_votes(code)[0]] for code in sorted(counts)}


def reliabilities(counts: dict[int, int]) -> tuple[dict[int, float], dict[tuple[int, int], dict[bool, list[float]]]]:
    """EM over pattern counts: how likely each pattern is real, and for each kind and labeler the chances of
    its votes (-1, 0, +1) on real and on other spans. Starts from the mean vote; counts are shares of their
    kind, to which ``PRIOR`` is added."""
    real = {}
    shares = _shares(counts)
    for code in counts:
        votes = _votes(code)[1]
        real[code] = min(0.95, max(0.05, 0.5 + sum(votes) / (2 * len(votes))))
    chances: dict[tuple[int, int], dict[bool, list[float]]] = {}
    for _ in range(ROUNDS):
        seen = defaultdict(lambda: {True: [PRIOR * x for x in OPINION], False: [PRIOR * x for x in reversed(OPINION)]})
        prior = defaultdict(lambda: [PRIOR, PRIOR])
        for code, n in shares.items():
            kind, votes, _, _ = _votes(code)
            prior[kind][0] += n * real[code]
            prior[kind][1] += n * (1 - real[code])
            for k, v in enumerate(votes):
                seen[kind, k][True][v + 1] += n * real[code]
                seen[kind, k][False][v + 1] += n * (1 - real[code])
        chances = {key: {side: [x / sum(c) for x in c] for side, c in sides.items()} for key, sides in seen.items()}
        for code in counts:
            kind, votes, _, _ = _votes(code)
            odds = math.log(prior[kind][0] / prior[kind][1])
            for k, v in enumerate(votes):
                odds += math.log(chances[kind, k][True][v + 1] / chances[kind, k][False][v + 1])
            real[code] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return real, chances


def train(counts: dict[int, int]) -> list[int]:
    """Pattern numbers of looser spans that the classifier accepts, of all that can occur."""
    real, _ = reliabilities(counts)
    sides = defaultdict(lambda: [PRIOR, PRIOR])
    totals = defaultdict(lambda: [2 * PRIOR, 2 * PRIOR])

    def features(code: int) -> list[tuple]:
        kind, votes, size, apart = _votes(code)
        return [(kind, "size", size), (kind, "apart", apart), *[(kind, name, v) for name, v in zip(LABELERS, votes, strict=True) if name != "pattern"]]

    for code, n in _shares(counts).items():
        kind = _votes(code)[0]
        for side, weight in enumerate((n * real[code], n * (1 - real[code]))):
            totals[kind][side] += weight
            for f in features(code):
                sides[f][side] += weight
    out = []
    for kind, *votes in product(range(len(KINDS)), (1,), *[range(3)] * (len(LABELERS) - 1)):
        for size, apart in product(range(4), range(3)):
            code = kind
            for v in votes:
                code = code * 3 + v
            code = (code * 4 + size) * 3 + apart
            if kind not in totals:
                continue
            odds = math.log(totals[kind][0] / totals[kind][1])
            for f in features(code):
                pair = sides[f]
                odds += math.log(pair[0] / totals[kind][0]) - math.log(pair[1] / totals[kind][1])
            if 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))) >= ACCEPT:
                out.append(code)
    return out


def find(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, strict and extra, arrays of (kind number, start, end).

    A null text is empty. Extra spans overlap no strict one and no other extra one (the first kind, then
    the first span counts; one that itself goes takes no other with it).
    Repeated rows are each looked at.
    """
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    strict, loose = spans_of(F.col("_text"))
    judged = cut_lineage(docs.select(F.col(doc).alias("doc_id"), plain.alias("_text")).select("doc_id", strict.alias("strict"), loose.alias("loose")))
    codes = judged.select(F.explode(F.concat("strict", "loose")).alias("s")).groupBy("s.code").count()
    accepted = train({r["code"]: r["count"] for r in codes.collect()})

    def of_kind(k: int, spans: str) -> Column:
        return F.filter(spans, lambda s: s["kind"] == k)

    def free(k: int, rivals: list[Column]) -> Column:
        return F.filter("loose", lambda s: (s["kind"] == k) & s["code"].isin(accepted) & ~reduce(or_, [_meets(r, s) for r in rivals]))

    # kind by kind: a span goes if it overlaps a strict one or one that stays; spans of one kind are disjoint
    out = judged.select("*", *[of_kind(k, "strict").alias(f"strict{k}") for k in range(len(STRICT))])
    rivals = [F.col(f"strict{k}") for k in range(len(STRICT))]
    kept = []
    for k in sorted(KINDS.index(k) for k in _LOOSE):
        out = out.withColumn(f"kept{k}", free(k, rivals + kept) if accepted else F.filter("loose", lambda s: F.lit(False)))
        kept.append(F.col(f"kept{k}"))
    first = F.concat(*kept)
    narrow = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return out.select("doc_id", narrow(F.col("strict")).alias("strict"), narrow(first).alias("extra"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of strict spans, their digest, and all spans of every document."""
    found = find(docs)
    kinds = F.col("strict.kind")
    counts = [(F.size("strict") - F.size(F.array_remove(kinds, KINDS.index(k)))).cast("bigint").alias(f"n_{k}") for k in STRICT]
    return found.select(
        "doc_id", *counts, F.sha2(_written(F.col("strict")), 256).alias("base_sha256"), _written(F.concat("strict", "extra")).alias("spans")
    )
