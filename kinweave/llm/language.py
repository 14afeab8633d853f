"""Language by compression: the language whose dictionary makes a text smallest.

For each language a raw-content zstandard dictionary is filled from a bounded sample of labelled
texts. Texts and samples are reduced to their lower-case letters and single spaces first. A text is cut into blocks so that the dictionary and not the text's own past explains it; the
language with the smallest sum of compressed sizes wins. A narrow margin to the second is a rejection.

Bounds of the fit (parameters): at most ``languages`` labels, the most frequent ones; per label the
labelled texts with the smallest hash in each of ``samples`` hash classes, of each at most
``sample_bytes`` from a place the hash gives, together at most ``dictionary_bytes``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import fresh, id_remainder, slices

LANGUAGES = 256
SAMPLES = 256
SAMPLE_BYTES = 1024
DICTIONARY_BYTES = 220 << 10
BLOCK_BYTES = 1024
LEVEL = 3
#: Least share of the second size that the smallest must save; below it the text is rejected.
MARGIN = 0.002
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def plain(text: str | None) -> bytes:
    """Lower-case runs of letters with one space between, a run repeated at once only once; signs, digits
    and line ends say nothing here."""
    return " ".join(w for w, _ in groupby(_LETTERS.findall(text.lower()))).encode("utf-8", "replace") if text else b""


#: zstandard leaves very short inputs as they are, whatever the dictionary; behind this they are coded.
_SHORT = 128
_BEFORE = bytes(97 + (k * k * 7 + k * 11 + k // 26 * 5) % 26 for k in range(256)) + b" "


def fit(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    languages: int = LANGUAGES,
    samples: int = SAMPLES,
    sample_bytes: int = SAMPLE_BYTES,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> dict[str, bytes]:
    """Language -> dictionary content, the most frequent language first, from the rows with a text and a label."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and text is not null and text <> ''")
    frequent = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    codes = rows.select("lang", F.xxhash64("text").alias("h"))
    chosen = codes.groupBy("lang", F.pmod("h", F.lit(samples)).alias("class")).agg(F.min("h").alias("h"))
    hits = rows.select("lang", F.xxhash64("text").alias("h"), "text").join(
        F.broadcast(chosen.join(F.broadcast(frequent), "lang").select("lang", "h", "count")), ["lang", "h"]
    )  # the broadcast has at most languages x samples rows
    place = F.pmod("h", F.greatest(F.lit(1), F.length("text") - sample_bytes)) + 1
    pieces = hits.select("lang", "h", "count", F.expr("text").substr(place.cast("int"), F.lit(sample_bytes)).alias("piece"))
    pieces = pieces.groupBy("lang", "h", "count").agg(F.min("piece").alias("piece"))
    content: dict[str, list[bytes]] = {}
    for row in sorted(pieces.collect(), key=lambda r: (-r["count"], r.lang, r.h)):  # bounded as the broadcast, sample_bytes characters each
        content.setdefault(row.lang, []).append(plain(row.piece))
    shares = {k: max(1, dictionary_bytes // len(v)) for k, v in content.items()}
    return {k: b" ".join(p[: shares[k]] for p in v)[:dictionary_bytes] for k, v in content.items()}


class Judge:
    """The learned dictionaries as compressors of one task."""

    def __init__(self, content: dict[str, bytes], level: int = LEVEL):
        import zstandard

        self.names = list(content)
        self.compressors = []
        for name in self.names:
            learned = zstandard.ZstdCompressionDict(content[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            learned.precompute_compress(level)
            self.compressors.append(
                zstandard.ZstdCompressor(level=level, dict_data=learned, write_content_size=False, write_dict_id=False)
            )

    def decide(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (0 to 1) and the share the smallest size saves against the second."""
        data = plain(text)
        if not data or not self.names:
            return UNKNOWN, 0.0, 0.0
        if len(data) < _SHORT:
            data = _BEFORE + data
        blocks = [data[k : k + BLOCK_BYTES] for k in range(0, len(data), BLOCK_BYTES)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]
        best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
        if len(sizes) == 1:
            return self.names[0], 1.0, 1.0
        second = min(s for k, s in enumerate(sizes) if k != best)
        likely = [math.exp(-60 * (s - sizes[best]) / max(1, second)) for s in sizes]
        return self.names[best], 1 / sum(likely), (second - sizes[best]) / max(1, second)


def identify(docs: DataFrame, content: dict[str, bytes], text: str = "text", margin: float = MARGIN) -> tuple[DataFrame, list[str]]:
    """``docs`` with three more columns, whose names are returned: language, score and whether the text is
    rejected: null, without a letter, or decided by less than ``margin``. Equal sizes go to the
    language with more labelled rows, and are rejected. Without any learned language all are ``und``."""
    names = fresh(docs, "lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(content)
    at = [c.lower() for c in docs.columns].index(text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in slices(batches, at):
            told = [judge.decide(t) for t in batch.column(at).to_pylist()]
            extra = [
                pa.array([t[0] for t in told], pa.string()),
                pa.array([t[1] for t in told], pa.float64()),
                pa.array([t[0] == UNKNOWN or t[2] < margin for t in told], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *names])

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # mapInArrow takes no names with dots
    schema = plain.select("*", F.lit("").alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(True).alias(names[2])).schema
    return plain.mapInArrow(run, schema).toDF(*docs.columns, *names), names


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document; learned from those not held out."""
    held_out = id_remainder("doc_id", 4, 2)
    content = fit(docs.where(~held_out))
    out, (lang, score, rejected) = identify(docs.select("doc_id", held_out.alias("held_out"), "text"), content)
    return out.select("doc_id", "held_out", F.col(lang).alias("lang_pred"), F.col(score).alias("score"), F.col(rejected).alias("rejected"))
