"""DuckDB SQL for the rows of those corpus queries that SQL can express. It compares all with all where the
operators have candidate searches, so it is for small tables."""

from __future__ import annotations

from kinweave.llm import decontaminate, filter_audit, mixture, shard_table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"[^\x20\x09-\x0D]+"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


#: Of the table ``link`` (a, b): every node with its smallest reachable one, itself left out.
_REACH = """
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM both_ways UNION SELECT reach.a, n.b FROM reach JOIN both_ways n ON n.a = reach.b),
least_of AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
"""

_MINHASH = f"""
WITH RECURSIVE worded AS (SELECT doc_id, {_words("text", _SPACED)} AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w
    ELSE list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2]) END) AS g
  FROM worded
),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingle x JOIN shingle y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM met JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), {_REACH}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least(low, d.doc_id), d.doc_id) AS component_id,
  coalesce(least(low, d.doc_id), d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN size ON size.doc_id = d.doc_id LEFT JOIN least_of ON least_of.a = d.doc_id
"""

_ITQ = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
link AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM usable p JOIN usable q ON p.label = q.label AND p.vec_id < q.vec_id
  WHERE CASE WHEN len(p.v) = len(q.v) THEN list_cosine_similarity(p.v, q.v) >= 0.93 ELSE false END
), {_REACH},
links AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least(low, e.vec_id), e.vec_id) AS component_id,
  coalesce(least(low, e.vec_id), e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN links ON links.a = e.vec_id LEFT JOIN least_of ON least_of.a = e.vec_id
"""

_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
_DECONTAMINATE = f"""
WITH doc AS (SELECT doc_id, {_words("text", _WORD)} AS w FROM documents),
item AS (SELECT item_id::VARCHAR AS item, {_words("text", _WORD)} AS w FROM benchmark),
sized AS (SELECT item, w, least(len(w), {decontaminate.WINDOW}) AS size FROM item WHERE len(w) > 0),
item_at AS (SELECT item, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM sized),
wanted AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM item_at),
doc_at AS (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM sized)),
seen AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g FROM doc_at),
hit AS (SELECT doc_id, size, i, item FROM seen JOIN wanted USING (size, g)),
spot AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS k FROM hit),
n_spot AS (SELECT doc_id, count(*) AS n FROM spot GROUP BY doc_id),
listed AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hit WHERE item IS NOT NULL GROUP BY doc_id)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM doc LEFT JOIN n_spot ON n_spot.doc_id = doc.doc_id LEFT JOIN listed ON listed.doc_id = doc.doc_id
"""

# The sources that are cut to three times their size are the first ones by size over weight.
_MIXTURE = f"""
WITH doc AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_SPACED}'))::BIGINT AS size,
    ('0x' || substr(md5(concat_ws(chr(31), '9', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 12))::BIGINT AS h
  FROM documents
),
total AS (SELECT source, sum(size)::BIGINT AS n FROM doc GROUP BY source),
named AS (SELECT source, n, ([{", ".join(f"{w}::DOUBLE" for w in mixture.WEIGHTS)}])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixture.WEIGHTS)} + 1] AS w FROM total),
ranked AS (SELECT *, row_number() OVER (ORDER BY n / w, source NULLS LAST) AS r, sum(n) OVER () AS everything FROM named WHERE n > 0),
rest AS (
  SELECT *, (everything - {mixture.MOST} * coalesce(sum(n) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS over,
    sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM ranked
),
first_open AS (SELECT over, weights, r FROM rest WHERE NOT over * w / weights > {mixture.MOST}::DOUBLE * n ORDER BY r LIMIT 1),
goal AS (
  SELECT source, n, CASE WHEN n = 0 THEN 0.0::DOUBLE WHEN rest.r < f.r THEN {mixture.MOST}::DOUBLE * n ELSE f.over * w / f.weights END AS target
  FROM (SELECT source, n, w, r FROM rest UNION ALL SELECT source, n, w, 0 FROM named WHERE n = 0) rest LEFT JOIN first_open f ON true
),
part AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE floor(target / n)::BIGINT END AS copies FROM goal),
budget AS (SELECT *, target - copies * n AS budget FROM part),
value AS (SELECT source, h, sum(size) AS n FROM doc GROUP BY source, h),
up_to AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM value),
edge AS (
  SELECT u.source, min(h) AS h, arg_min(u.n, h) AS n, arg_min(upto, h) - arg_min(u.n, h) AS before
  FROM up_to u JOIN budget b ON u.source IS NOT DISTINCT FROM b.source WHERE upto > budget AND budget > 0 GROUP BY u.source
),
below AS (
  SELECT b.*, CASE WHEN b.n = 0 OR budget <= 0 THEN 0 WHEN e.h IS NULL THEN 1::BIGINT << {mixture.BITS * mixture.LEVELS}
    ELSE e.h + (2 * (budget - before) > e.n)::BIGINT END AS below
  FROM budget b LEFT JOIN edge e ON e.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, b.n AS source_size, target, (size * (copies + (h < below)::BIGINT))::BIGINT AS taken
FROM doc JOIN below b ON b.source IS NOT DISTINCT FROM doc.source
"""

_TERM_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_PIPELINE = f"""
WITH doc AS (SELECT row_number() OVER () AS d, doc_id, {_words("text", _TERM_WORDS)} AS w FROM documents),
full_doc AS (SELECT d, doc_id, len(w)::BIGINT AS n, w FROM doc WHERE len(w) > 0),
item AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_words("text", _TERM_WORDS)}) AS w FROM benchmark),
asked AS (SELECT i, item_id, unnest(w) AS t FROM item),
held AS (SELECT d, unnest(w) AS t FROM full_doc),
times AS (SELECT d, t, count(*)::BIGINT AS tf FROM held WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM full_doc),
weight AS (
  SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS v FROM times, total GROUP BY t, docs
),
part AS (
  SELECT i, d, (v * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))))::BIGINT AS s
  FROM times JOIN weight USING (t) JOIN asked USING (t) JOIN full_doc USING (d), total
),
scored AS (SELECT i, d, sum(s)::BIGINT AS score FROM part GROUP BY ALL HAVING sum(s) > 0),
ranked AS (
  SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank
  FROM scored JOIN full_doc USING (d)
)
SELECT item_id, rank, doc_id, score FROM ranked JOIN item USING (i) WHERE rank <= 50
"""

_FAILS = ("words < 100", "100 * distinct_words < 80 * words", "100 * capitals > 10 * chars", "marked", "again")
_ORDERS = ", ".join(f"('{order}', {step + 1}, '{letter}', '{order[:step]}')" for order in filter_audit.ORDERS for step, letter in enumerate(order))
_FILTER_AUDIT = f"""
WITH told AS (
  SELECT doc_id AS of, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
),
doc AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents
),
seen AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) AS words, len(list_distinct(w)) AS distinct_words,
    length(t) AS chars, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals, regexp_matches(t, '[#$%&*|]') AS marked,
    coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS again
  FROM doc LEFT JOIN told ON told.of = doc.doc_id
),
mask AS (
  SELECT part, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic,
    {" || ".join(f"CASE WHEN {fails} THEN '{letter}' ELSE '' END" for letter, fails in zip(filter_audit.FILTERS, _FAILS, strict=True))} AS fails
  FROM seen GROUP BY ALL
),
step AS (SELECT * FROM (VALUES {_ORDERS}) v(filter_order, step, letter, earlier)),
met AS (
  SELECT *, contains(fails, letter) AS now, translate(fails, earlier, '') <> fails AS gone FROM mask, step
),
row AS (
  SELECT part, filter_order, step::INTEGER AS step, letter,
    coalesce(sum(n) FILTER (NOT now AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (now AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (now AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = letter), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (now AND NOT gone), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (now AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM met GROUP BY ALL
)
SELECT * EXCLUDE letter, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM row
"""


def _shard_table() -> str:
    """The filled table is a constant of the query; the tests hold it against taking turns slot by slot."""
    names = [f"shard-{k:03d}" for k in range(shard_table.SHARDS)]
    return f"""
WITH keyed AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce('i' || doc_id::VARCHAR, 't' || text, '')), 1, 15))::BIGINT % {shard_table.SIZE} AS slot
  FROM documents
),
filled AS (SELECT string_split('{",".join(map(str, shard_table.fill(names)))}', ',') AS taken)
SELECT doc_id, slot, printf('shard-%03d', taken[slot + 1]::INTEGER) AS shard FROM keyed, filled
"""


ORACLE: dict[str, str] = {
    "op6_minhash": _MINHASH,
    "op7_decontaminate": _DECONTAMINATE,
    "op8_itq": _ITQ,
    "op9_mixture": _MIXTURE,
    "op10_shard_table": _shard_table(),
    "op12_term_pipeline": _TERM_PIPELINE,
    "op13_filter_audit": _FILTER_AUDIT,
}
