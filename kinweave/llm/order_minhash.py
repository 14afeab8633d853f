"""Fingerprints of texts that follow edit distance: Order MinHash, in DataFrame functions only.

A text's letters are its words, cut after 16 code points so that long runs are no single letter; code
points of scripts that are written without spaces are letters each, and white space is none. Its items are
the k-mers of letters, each numbered by how often the same k-mer stood before it, so that repeats count. Every item has a 31-bit hash, a place on a circle. Each of
``sketches`` equally spaced points ranks all items by their way round the circle from that point; the
``tuple_size`` lowest are taken, put back into the order they have in the text, and hashed together. Two
texts agree in a sketch if they have the same lowest items in the same order, so moved passages count as
differences, which they do not for sets of k-mers. The share of agreeing sketches is the likeness.

One text is worked on at a time, in arrays: a long per letter. Hashes are sorted, so neither repeats nor
points need to search. Texts shorter than a k-mer are one item; null texts and those without a letter have no
item, an empty fingerprint, likeness 1 to each other and 0 to all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import fresh

KMER = 2
SKETCHES = 64
TUPLE = 2
#: At most so many ranges of ids, and quantiles that found them; bounds what is broadcast.
RANGES, QUANTILES, ROWS_PER_RANGE = 65_536, 256, 1_000

#: Thai, Lao, Myanmar, Khmer, and the ideographs and syllables of East Asia.
_APART = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{A4CF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
LETTER = rf"[^\x20\x09-\x0D{_APART}]{{1,16}}|[{_APART}]"

_LOW = 0xFFFFFFFF


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, not again for each element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _item(number: Column, place: Column) -> Column:
    """The top 31 bits of a hash and below them the place in the text, counted from 1."""
    return F.shiftleft(F.shiftrightunsigned(number, 33), 32).bitwiseOR(place)


def _hash(item: Column) -> Column:
    return F.shiftright(item, 32)


def _kmers(letters: Column, k: int) -> Column:
    def of(letter):
        starts = F.sequence(F.lit(0), F.greatest(F.size(letter) - k, F.lit(0)))
        # A get beyond the end is null, which a hash leaves out.
        return F.transform(
            starts, lambda at: _item(F.xxhash64(*[F.get(letter, at + j) for j in range(k)]), (at + 1).cast("bigint"))
        )

    return F.when(F.size(letters) == 0, F.array().cast("array<bigint>")).otherwise(_bound(letters, of))


def _same_as_before(items: Column, at: Column) -> Column:
    return F.coalesce(_hash(F.get(items, at)) == _hash(F.get(items, at - 1)), F.lit(False))


def _numbered(again: Column) -> Column:
    """The sorted repeats of k-mers as items of their own: the first repeat is number 1, and so on."""

    def of(items):
        def runs(starts):
            def run(start, nth):
                stop = F.coalesce(F.get(starts, nth + 1), F.size(items)) - 1
                return F.transform(
                    F.sequence(start, stop),
                    lambda at: _item(
                        F.xxhash64(_hash(F.get(items, at)), at - start + 1), F.get(items, at).bitwiseAND(_LOW)
                    ),
                )

            return F.flatten(F.transform(starts, run))

        places = F.sequence(F.lit(0), F.size(items) - 1)
        return _bound(F.filter(places, lambda at: ~_same_as_before(items, at)), runs)

    return F.when(F.size(again) == 0, F.array().cast("array<bigint>")).otherwise(_bound(again, of))


def _signature(items: Column, marked: Column, tuple_size: int) -> Column:
    """``marked``: the sorted items with the points among them, which have place 0."""

    def of(item):
        def tuples(places):
            def hashed(place, nth):
                def pick(step):
                    one = F.get(item, (place - nth + step) % F.size(item))
                    return F.shiftleft(one, 32).bitwiseOR(_hash(one))  # now the place leads

                picks = F.sort_array(F.transform(F.sequence(F.lit(0), F.lit(tuple_size - 1)), pick))
                values = F.transform(picks, lambda p: p.bitwiseAND(_LOW))
                return F.shiftrightunsigned(F.xxhash64(values), 33).cast("int")

            return F.transform(places, hashed)

        at = F.sequence(F.lit(0), F.size(marked) - 1)
        points = _bound(marked, lambda m: F.filter(at, lambda i: F.get(m, i).bitwiseAND(_LOW) == 0))
        return _bound(points, tuples)

    return F.when(F.size(items) == 0, F.array().cast("array<int>")).otherwise(_bound(items, of))


def fingerprints(
    df: DataFrame, text: str, out: str, k: int = KMER, sketches: int = SKETCHES, tuple_size: int = TUPLE
) -> DataFrame:
    """All columns and ``out``, a new name, an array of ``sketches`` integers (none for null and empty texts).

    Sorting stands in steps of its own, each read more than once by the next one, so that it stays
    compiled code over arrays of longs.
    """
    own = [F.col(f"`{c}`") for c in df.columns]
    item, more = fresh(df, "_item", "_more")
    points = F.array(*[F.lit((j << 31) // sketches << 32) for j in range(sketches)]).cast("array<bigint>")
    letters = F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(LETTER), F.lit(0))
    step = df.select(*own, letters.alias(item))
    step = step.select(*own, _kmers(F.col(item), k).alias(item))
    step = step.select(*own, F.when(F.size(item) > 1, F.sort_array(item)).otherwise(F.col(item)).alias(item))

    def kept(first: bool):
        def of(items):
            return F.filter(items, lambda x, at: _same_as_before(items, at) != F.lit(first))

        return _bound(F.col(item), of)

    step = step.select(*own, kept(True).alias(item), kept(False).alias(more))
    step = step.select(*own, F.concat(F.col(item), _numbered(F.col(more))).alias(item))
    step = step.select(*own, F.sort_array(item).alias(item), F.sort_array(F.concat(F.col(item), points)).alias(more))
    return step.select(*own, _signature(F.col(item), F.col(more), tuple_size).alias(out))


def likeness(one: Column, other: Column) -> Column:
    """The share of sketches in which two fingerprints agree; 1 for two without any."""
    same = F.size(F.filter(F.zip_with(one, other, lambda a, b: a.eqNullSafe(b)), lambda x: x))
    most = F.greatest(F.size(one), F.size(other))
    return F.when(most == 0, F.lit(1.0)).otherwise(same.cast("double") / most)


def written(fingerprint: Column) -> Column:
    """As text, eight hexadecimal digits a sketch."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def with_next(docs: DataFrame, key: str, text: str, build) -> DataFrame:
    """Every document with the text and fingerprint of the one after it by ascending key (nulls first, then
    by text), and of the first one after the last: columns ``key``, ``text``, ``fingerprint``,
    ``next_text``, ``next_fingerprint``. ``build`` adds the fingerprint to a table.

    Ids are integers or null. They are cut into ranges at quantiles and evenly between them; each range is sorted by itself, and
    gets a copy of the first document of the next one. The texts are shuffled once. Equal ids stay in one
    range, which is sorted by one task, spilling where it must.
    """
    least = -(1 << 63)
    rows = docs.select(
        F.col(f"`{key}`").alias("key"),
        F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(least)).alias("at"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    shares = [(i + 1) / QUANTILES for i in range(QUANTILES)]
    count, cuts = rows.agg(F.count("*"), F.percentile_approx("at", shares, 10_000)).first()
    pieces = max(1, min(RANGES // (QUANTILES + 1), -(-count // (ROWS_PER_RANGE * QUANTILES))))
    every = max(1, QUANTILES * ROWS_PER_RANGE // max(1, count))
    cuts = sorted(set((cuts or [0])[every - 1 :: every]))
    edges = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")

    def number(at):
        def of(coarse):
            low, high = F.get(edges, coarse - 1).cast("double"), F.get(edges, coarse).cast("double")
            share = F.least(F.floor((at.cast("double") - low) / (high - low) * pieces), F.lit(pieces - 1))
            return coarse * pieces + F.coalesce(F.greatest(share, F.lit(0)), F.lit(0)).cast("int")

        return _bound(F.size(F.filter(edges, lambda c: c <= at)), of)

    rows = rows.select("*", number(F.col("at")).alias("range"))
    first = rows.groupBy("range").agg(F.min("at").alias("first"))
    order = Window.orderBy("range")  # of at most RANGES rows
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.lag("range").over(order)
    heads = first.select(
        "first", F.coalesce(before, F.max("range").over(whole)).alias("to"), before.isNull().cast("int").alias("round")
    )
    copies = rows.join(F.broadcast(heads), F.col("at") == F.col("first"))
    both = rows.select("key", "text", "range", F.lit(0).alias("round"), F.lit(False).alias("copy")).union(
        copies.select("key", "text", "to", "round", F.lit(True))
    )
    line = Window.partitionBy("range").orderBy("round", F.col("key").asc_nulls_first(), "text")
    both = build(both)
    return both.select(
        "key",
        "text",
        "fingerprint",
        F.lead("text").over(line).alias("next_text"),
        F.lead("fingerprint").over(line).alias("next_fingerprint"),
        "copy",
    ).where("not copy").drop("copy")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of the texts and of their edited forms: the last quarter of the code points replaced by
    as many of the next document's first ones. One row per row of ``docs``; repeated ids each have theirs."""
    paired = with_next(docs, key, text, lambda df: fingerprints(df, "text", "fingerprint"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(
        F.col("text").substr(F.lit(1), n - quarter), F.col("next_text").substr(F.lit(1), quarter)
    )
    out = fingerprints(paired.withColumn("edited", edited), "edited", "edited_fingerprint")
    return out.select(
        F.col("key").alias("doc_id"),
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("fingerprint")).alias("fingerprint"),
        written(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
