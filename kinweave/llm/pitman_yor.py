"""Word scores by a hierarchical Pitman-Yor model, its seating sampled by Gibbs over the whole corpus.

Every word, and the end of a text, is a context with a restaurant of its own, in which the words after it
sit; all restaurants share one parent, the restaurant of single words, whose base is uniform over the known
words and one unknown. A table opened in a context sends a customer to the parent.

A pair of neighbours that occurs once in all texts that are learned from has one table in every sweep. So
sweeps run over the pairs that occur more often; of the others only their number by context and by word is kept,
and those that held-out texts hold as well stay. Pairs live in blocks by range of contexts and part of the words,
words in ranges, both as arrays in one row each; what a block and a range have to tell each other in a sweep is one
row for the two, with each word of the block once. Nothing is sized by the words of the corpus. A sweep sums tables
by context and by word, tells both sums to the blocks, and seats every pair anew. Given
the other words' tables, a word with c customers in a context opens t tables with a probability that weighs
all its seatings with t tables (generalised Stirling numbers), and that is drawn at once; beyond ``EXACT``
customers the rest are seated in runs of a sixteenth. Draws are hashes of pair and sweep, the same on any
partitioning. Pair probabilities of the sweeps after the first ``BURN`` are averaged.

Then groups of texts ask ranges for their words' facts, and blocks for what their pairs differ by from one that
occurs once (where texts are learned from) or never (where they are held out), each word and pair once, and are
scored. Pairs with a share of over ``HOT_SHARE`` are broadcast instead. Each step's table is deleted when the next
one is written, and shuffle files when their step ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import coded_words, hashes, id_remainder, mixed, slices
from kinweave.session import cut_lineage, dropped, shuffles_cleared

HOT_SHARE = 1e-4
BURN = 1
SWEEPS = 3
EXACT = 32
STRENGTH = 1.0
#: Bytes of text in a chunk or group; bytes of all texts per block, at least where there are enough blocks for all tasks.
CHUNK = 8 << 20
SHARE = 16 << 20
LEAST = 4 << 20
#: In so many passes are texts scored, where there are enough, so that only one pass's shuffle files are there at once.
PASSES = 3
#: So many buckets share the pairs of a context, so that no frequent word makes one large bucket.
SPLIT = 16
#: The word that ends each text, and the context of the first word of the next.
END = np.uint64(0x9E3779B97F4A7C15)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start in sorted arrays."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _stretches(of: np.ndarray) -> list[tuple[int, int, int]]:
    """Each value of a sorted array, and from where to where it is."""
    edges = np.append(_runs(of), len(of)).tolist()
    return list(zip(of[edges[:-1]].tolist(), edges[:-1], edges[1:], strict=True))


def _keys(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    """One number for each pair of neighbours."""
    return mixed(words ^ mixed(before))


def _buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each pair; sorted keys have sorted buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _blocks(words: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The blocks that each word's pairs are in as a context, first of its range, and as a word, of those of a range.
    Both follow the order of ``_buckets``, so that a block's words are in few ranges of words."""
    return _buckets(words, ranges).astype(np.int64) * SPLIT, (words >> np.uint64(60)).astype(np.int64)


def _packed(x: np.ndarray) -> bytes:
    """An array, whole numbers in as few bytes as the largest needs."""
    if x.dtype.kind == "i":
        x = x.astype(next(k for k in "bhiq" if np.iinfo(k).min <= x.min(initial=0) and x.max(initial=0) <= np.iinfo(k).max))
    return x.tobytes() + x.dtype.char.encode()


def _unpacked(x: bytes) -> np.ndarray:
    kind = np.dtype(x[-1:].decode())
    got = np.frombuffer(x, kind, (len(x) - 1) // kind.itemsize)
    return got.astype(np.int64) if kind.kind == "i" else got


def _joined(arrays: list[bytes], kind=np.int64) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *map(_unpacked, arrays)])


def _ordered(*fields: tuple[np.ndarray, int]) -> list[np.ndarray]:
    """Numbers below their limits, sorted by the first, then the second and so on; as one number where that has 64 bits."""
    bits = [max(1, int(limit - 1).bit_length()) for _, limit in fields]
    if sum(bits) > 64:
        order = np.lexsort([x for x, _ in reversed(fields)])
        return [x[order] for x, _ in fields]
    key = np.zeros(len(fields[0][0]), dtype=np.uint64)
    for (x, _), n in zip(fields, bits, strict=True):
        key = key << np.uint64(n) | x.astype(np.uint64)
    key.sort()
    out = []
    for n in reversed(bits):
        out.append((key & np.uint64((1 << n) - 1)).astype(np.int64))
        key = key >> np.uint64(n)
    return out[::-1]


def _count(blocks: int):
    """Per chunk and block its distinct pairs by context; twice how often they occur in texts that are learned
    from, and one more if held-out texts hold them."""
    ranges = -(-blocks // SPLIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, CHUNK):
            w, doc, u, x = _numbered(batch.column(1))
            if not len(w):
                continue
            learned = ~pc.fill_null(batch.column(2), True).to_numpy(zero_copy_only=False)
            first, part = _blocks(x, ranges)
            block, u, w, n = _ordered((first[u] + part[w], ranges * SPLIT), (u, len(x)), (w, len(x)), (learned[doc], 2))
            at = _runs(block, u, w)
            every = np.diff(np.append(at, len(w)))
            n = np.add.reduceat(n, at)
            block, u, w, code = block[at], u[at], w[at], 2 * n + (every > n)
            rows = {k: [] for k in ("bucket", "u", "runs", "w", "code")}
            for b, i, j in _stretches(block):
                run = _runs(u[i:j])
                row = (b, _packed(x[u[i:j][run]]), _packed(np.diff(np.append(run, j - i))), _packed(x[w[i:j]]), _packed(code[i:j]))
                for k, v in zip(rows, row, strict=True):
                    rows[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int32()), *[pa.array(v, pa.binary()) for k, v in rows.items() if k != "bucket"]], names=list(rows))

    return run


COUNTS = "bucket int, u binary, runs binary, w binary, code binary"
#: What moves between blocks and ranges of words: to which of them, what it is, who sent it; arrays; sums.
MOVED = "bucket int, kind string, peer int, kept array<binary>, sent array<binary>, sums array<bigint>"


def _merge(table: pa.Table) -> pa.Table:
    """A bucket's pairs that need rows, and rows without ``w`` that say how many customers, and pairs with one
    customer, each word has in it: as a word, and as a context."""
    u, runs, w, code = (_joined(table.column(n).to_pylist(), k) for n, k in zip(("u", "runs", "w", "code"), (np.uint64, np.int64) * 2, strict=True))
    u, w = _signed(np.repeat(u, runs)), _signed(w)
    order = np.argsort(_keys(w.view(np.uint64), u.view(np.uint64)))
    u, w, code = u[order], w[order], code[order]
    at = _runs(u, w)
    c, held = np.add.reduceat(code >> 1, at), np.logical_or.reduceat(code & 1, at)
    u, w = u[at], w[at]
    need = (c > 1) | ((c == 1) & held)
    none = np.zeros(0, dtype=np.int64)
    columns = [[u[need]], [w[need]], [c[need]], [none], [none], [none], [none]]
    for words, own in ((w, 3), (u, 5)):
        order = np.argsort(words)
        at = _runs(words[order])
        columns[0].append(words[order][at])
        for k in (3, 5):
            columns[k].append(np.add.reduceat(c[order], at) if k == own else np.zeros(len(at), np.int64))
            columns[k + 1].append(np.add.reduceat((c[order] == 1).astype(np.int64), at) if k == own else np.zeros(len(at), np.int64))
    sums = [np.concatenate(x) for x in columns]
    rows, more = int(need.sum()), len(sums[0]) - int(need.sum())
    empty = lambda n: pa.nulls(n, pa.int64())
    return pa.Table.from_arrays(
        [pa.array(sums[0]), *[pa.chunked_array([pa.array(x), empty(more)]) for x in sums[1:3]], *[pa.chunked_array([empty(rows), pa.array(x)]) for x in sums[3:]]],
        names=["u", "w", "c", "cw", "one_w", "cu", "one_u"],
    )


def _stirling(d: float) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t) for c, t up to EXACT."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(EXACT):
        for t in range(1, c + 2):
            stay = out[c, t] + np.log(c - d * t) if c - d * t > 0 else -np.inf
            out[c + 1, t] = np.logaddexp(out[c, t - 1], stay)
    return out


def uniforms(keys: np.ndarray, *salts: int) -> np.ndarray:
    """A number in (0, 1) for each key: the same wherever, and however often, it is drawn."""
    x = np.asarray(keys, dtype=np.uint64)
    for salt in salts:
        x = mixed(x + np.uint64(salt + 1) * END)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def binomials(n: np.ndarray, p: np.ndarray, keys: np.ndarray, *salts: int) -> np.ndarray:
    """Binomial draws settled by the keys: by inversion up to a mean of ``EXACT``, beyond it by the normal
    approximation."""
    q = np.minimum(p, 1 - p)
    first = uniforms(keys, *salts, 0)
    normal = np.sqrt(-2 * np.log(first)) * np.cos(2 * np.pi * uniforms(keys, *salts, 1))
    drawn = np.clip(np.rint(n * q + normal * np.sqrt(n * q * (1 - q))), 0, n).astype(np.int64)
    at = np.flatnonzero(n * q <= EXACT)
    drawn[at] = 0
    mass = np.exp(n[at] * np.log1p(-q[at]))
    left = first[at] - mass
    while len(at := at[left > 0]):
        mass, left = mass[left > 0], left[left > 0]
        k = drawn[at]
        mass = mass * (n[at] - k) / (k + 1) * (q[at] / (1 - q[at]))
        drawn[at] = k + 1
        left = np.where(k + 1 < n[at], left - mass, 0.0)
    return np.where(p > 0.5, n - drawn, drawn)


def seat(c: np.ndarray, opened: np.ndarray, d: float, keys: np.ndarray, sweep: int, log_s: np.ndarray) -> np.ndarray:
    """Tables of c customers of one dish each, where ``opened`` is (strength + d * tables) * parent's
    probability: drawn exactly up to EXACT customers; further ones in runs of a sixteenth of those seated.
    Draws follow from the dishes' ``keys`` and the sweep, so neither partitions nor repeated tasks change them."""
    t = np.ones(len(c), dtype=np.int64)
    weight = np.log(np.maximum(opened, 1e-300))
    few = np.flatnonzero(c > 1)
    few = few[np.argsort(c[few], kind="stable")]  # so that a part is as wide as its own customers ask for
    for part in np.array_split(few, len(few) // 50_000 + 1):
        if len(part):
            k = np.arange(1, min(EXACT, c[part[-1]]) + 1)
            logs = log_s[np.minimum(c[part], EXACT), 1 : len(k) + 1] + k * weight[part, None]
            p = np.exp(logs - logs.max(axis=1, keepdims=True)).cumsum(axis=1)
            t[part] = 1 + (p < uniforms(keys[part], sweep)[:, None] * p[:, -1:]).sum(axis=1)
    left = np.flatnonzero(c > EXACT)
    seated = EXACT
    while len(left):
        run = max(1, seated // 16)
        take = np.minimum(run, c[left] - seated)
        new = opened[left] / (opened[left] + np.maximum(seated - d * t[left], 1e-9))
        t[left] += binomials(take, new, keys[left], sweep, seated)
        seated += run
        left = left[c[left] > seated]
    return t


def _moved(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int64()))
    names = [f.split()[0] for f in MOVED.split(", ")]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _rows(table: pa.Table) -> dict[str, list[dict]]:
    """Rows by what they are, in order of their senders."""
    out = {}
    for r in sorted(table.to_pylist(), key=lambda r: r["peer"]):
        out.setdefault(r["kind"], []).append(r)
    return out


def _asks(block: int, blocks: int, x: np.ndarray, u: np.ndarray, w: np.ndarray, c: np.ndarray, t: np.ndarray) -> list[tuple]:
    """A block's words to their ranges, with their tables of the pairs that occur more than once."""
    t = np.where(c > 1, t, 0)
    a, b = (np.bincount(k, t, len(x)).astype(np.int64) for k in (w, u))
    return [(r, "ask", block, None, [_packed(x[i:j]), _packed(a[i:j]), _packed(b[i:j])], None) for r, i, j in _stretches(_buckets(x, blocks))]


def _start(blocks: int):
    """A block's pairs with one table each, and what its words are in it."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("bucket")[0].as_py()
        rows = _merge(table)
        pairs = rows.filter(pc.is_valid(rows.column("w")))
        u, w, c = (pairs.column(n).to_numpy() for n in ("u", "w", "c"))
        x, place = np.unique(np.concatenate([w, u]).view(np.uint64), return_inverse=True)
        w, u = place[: len(c)], place[len(c) :]
        out = [(block, "block", block, [_packed(v) for v in (x, u, w, c, np.ones_like(c), np.zeros_like(c), np.zeros(len(c)))], None, [int((c == 2).sum())])]
        out += _asks(block, blocks, x, u, w, c, np.ones_like(c))
        rows = rows.filter(pc.is_null(rows.column("w")))
        sums = [rows.column(n).to_numpy() for n in ("u", "cw", "one_w", "cu", "one_u")]
        order = np.argsort(sums[0].view(np.uint64))
        x, *sums = (v[order] for v in sums)
        x = x.view(np.uint64)
        out += [(r, "count", block, None, [_packed(v[i:j]) for v in (x, *sums)], None) for r, i, j in _stretches(_buckets(x, blocks))]
        return _moved(out)

    return run


def _range(fresh: float | None, d: float, sweep: int):
    """A range's words: tables in their contexts and in the parent, where each has one before the first sweep; told
    to the blocks that asked."""

    def run(table: pa.Table) -> pa.Table:
        rows = _rows(table)
        if sweep:
            (own,) = rows["words"]
            x, cw, one_w, cu, one_u, *kept = map(_unpacked, own["kept"])
        else:
            sent = list(zip(*[r["sent"] for r in rows["count"]], strict=True))
            x, place = np.unique(_joined(sent[0], np.uint64), return_inverse=True)
            cw, one_w, cu, one_u = (np.bincount(place, _joined(v), len(x)).astype(np.int64) for v in sent[1:])
            kept = []
        asks = rows.get("ask", [])
        places = [np.searchsorted(x, _unpacked(r["sent"][0])) for r in asks]
        place = np.concatenate([np.empty(0, np.int64), *places])
        k, s = (n + np.bincount(place, _joined([r["sent"][i] for r in asks]), len(x)).astype(np.int64) for n, i in ((one_w, 1), (one_u, 2)))
        z = np.ones(len(x), dtype=np.int64) if fresh is None else seat(k, np.full(len(x), fresh), d, x, sweep, _stirling(d))
        z = np.where(k > 0, z, 0)
        kept = [*kept, s, k, z] if sweep >= BURN else []
        sums = [int(v) for v in (k.sum(), z.sum(), (k == 1).sum(), (k == 2).sum(), (cw > 0).sum(), cw.sum(), one_w.sum())]
        own = table.column("bucket")[0].as_py()
        out = [(own, "words", own, [_packed(v) for v in (x, cw, one_w, cu, one_u, *kept)], None, sums)]
        out += [(r["peer"], "told", own, None, [_packed(v[at]) for v in (s, k, z)], None) for r, at in zip(asks, places, strict=True)]
        return _moved(out)

    return run


def _word(customers: np.ndarray, t0: np.ndarray, g: dict) -> np.ndarray:
    """The parent's probability of a word."""
    return (customers - g["d0"] * t0 + g["fresh"]) / (STRENGTH + g["C0"])


def _sweep(g: dict, blocks: int, counts: bool, last: bool):
    """One pass over a block's pairs: a new seating, beside the sum of those before it that count, and of what does
    not hang on the pair itself. After the last one, by how much the log of a pair's probability is above that of a
    pair that occurs once, and of one that never does; the frequent ones once more."""

    def run(table: pa.Table) -> pa.Table:
        rows = _rows(table)
        (own,) = rows["block"]
        block, d = own["bucket"], g["d1"]
        x, u, w, c, t, seated, rest = map(_unpacked, own["kept"])
        s, k, z = (_joined([r["sent"][i] for r in rows.get("told", [])]) for i in range(3))
        opened = (STRENGTH + d * s)[u] * _word(k, z, g)[w]
        keys = _keys(x[w], x[u])
        if counts:
            rest, seated = rest + opened, seated + t
        if not last:
            t = seat(c, opened, d, keys, g["sweep"], _stirling(d))
            kept = [_packed(v) for v in (x, u, w, c, t, seated, rest)]
            return _moved([(block, "block", block, kept, None, None), *_asks(block, blocks, x, u, w, c, t)])
        log = np.log10(SWEEPS * c - d * seated + rest)
        out = [keys, log - np.log10(SWEEPS * (1 - d) + rest), log - np.log10(rest)]  # sorted, as _merge left the pairs
        hot = c >= max(2, HOT_SHARE * g["N"])
        return _moved([(block, "pairs", block, [_packed(v) for v in out], [_packed(v[hot]) for v in out], None)])

    return run


def _discount(one: int, two: int) -> float:
    return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5


def _numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``_tokens`` returns, words as places in the sorted distinct hashes; and those."""
    codes, bounds, known = coded_words(texts)
    hashed = hashes(known)
    distinct = np.unique(np.append(hashed, END))
    n = np.diff(bounds) + 1
    end = np.searchsorted(distinct, END)
    words = np.full(len(codes) + len(n), end)
    inner = np.ones(len(words), dtype=bool)
    inner[np.cumsum(n) - 1] = False
    words[inner] = np.searchsorted(distinct, hashed)[codes]
    return words, np.repeat(np.arange(len(n)), n), np.concatenate([[end], words[:-1]]), distinct


def _text(table: pa.Table) -> pa.Array:
    return pa.concat_arrays(table.column("text").chunks)


def _asked(text: pa.Array, ranges: int, hot: np.ndarray, *more: str):
    """Tokens of texts, known words, and the distinct pairs in the order of blocks: block, key, whether it is
    broadcast; with every occurrence's pair and text if wanted."""
    w, doc, u, x = _numbered(text)
    first, part = _blocks(x, ranges)
    fields = [(first[u] + part[w], ranges * SPLIT), (u, len(x)), (w, len(x)), *([(doc, len(text))] if more else [])]
    block, us, ws, *docs = _ordered(*fields)
    at = _runs(block, us, ws)
    of = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(ws)))) if more else None
    block, key = block[at], _keys(x[ws[at]], x[us[at]])
    place = np.minimum(np.searchsorted(hot, key), max(0, len(hot) - 1))
    sent = hot[place] != key if len(hot) else np.ones(len(key), dtype=bool)
    return (w, doc, u), x, (block, key, place, sent), (of, docs[0] if more else None)


def _ask(ranges: int, hot):
    """A group's distinct words for each range and pairs for each block."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        _, x, (block, key, _, sent), _ = _asked(_text(table), ranges, hot.value[0])
        block, key = block[sent], key[sent]
        words = {r: x[i:j] for r, i, j in _stretches(_buckets(x, ranges * SPLIT))}
        pairs = {b: key[i:j] for b, i, j in _stretches(block)}
        none = np.empty(0, np.uint64)
        return _moved([(b, "ask", part, None, [_packed(v.get(b, none)) for v in (words, pairs)], None) for b in sorted({*words, *pairs})])

    return run


def _answer(asked: pa.Table, known: pa.Table) -> pa.Table:
    """The facts of the words and pairs a group asked for, in its order; zero for pairs without a row. Held-out groups
    have odd numbers."""
    rows = _rows(known)
    x, cw, _, cu, _, *facts = map(_unpacked, rows["words"][0]["kept"]) if "words" in rows else (np.empty(0, np.uint64),) * 5
    keys, *values = map(_unpacked, rows["pairs"][0]["kept"]) if "pairs" in rows else (np.empty(0, np.uint64),) * 3
    out = []
    for r in asked.to_pylist():
        words, pairs = map(_unpacked, r["sent"])
        at = np.searchsorted(x, words)
        up, value = np.zeros(len(pairs)), values[r["peer"] & 1]
        place = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
        found = keys[place] == pairs if len(keys) else np.zeros(len(pairs), dtype=bool)
        up[found] = value[place[found]]
        out.append((r["peer"], "facts", r["bucket"], None, [_packed(up), *[_packed(f[at]) for f in (cw, cu, *facts)] * bool(len(words))], None))
    return _moved(out)


def _score_group(sweeps: list[dict], ranges: int, hot):
    """Documents of a group, their pairs taken as those that occur once or never, and what they differ by from that."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        g, n_docs = sweeps[0], table.num_rows
        if not n_docs:
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.bool_(), *(pa.int64(),) * 2, *(pa.float64(),) * 2)], names=SCORED_NAMES)
        held = table.column("part")[0].as_py() & 1
        (w, doc, u), x, (_, _, place, sent), (of, docs) = _asked(_text(table), ranges, hot.value[0], "docs")
        rows = [r["sent"] for r in _rows(told)["facts"]]
        cw, cu, *facts = (_joined([r[k] for r in rows if len(r) > 1]) for k in range(1, 3 + 3 * len(sweeps)))
        up = np.empty(len(sent))
        up[sent] = _joined([r[0] for r in rows], np.float64)
        up[~sent] = hot.value[1 + held][place[~sent]]
        rest = np.zeros(len(w))
        for k, one in enumerate(sweeps):
            s, customers, z = facts[3 * k : 3 * k + 3]
            rest += (STRENGTH + g["d1"] * s)[u] * _word(customers, z, one)[w]
        score = np.log10((rest if held else SWEEPS * (1 - g["d1"]) + rest) / (SWEEPS * (STRENGTH + cu[u])))
        base = np.log10((cw + 0.1) / (g["N"] + 0.1 * (g["V"] + 1)))[w]
        sums = np.bincount(doc, base, n_docs), np.bincount(doc, score, n_docs) + np.bincount(docs, up[of], n_docs)
        known = np.bincount(doc, cw[w] > 0, n_docs).astype(np.int64)
        out = [table.column("doc_id"), table.column("held_out"), pa.array(np.bincount(doc, minlength=n_docs)), pa.array(known), *map(pa.array, sums)]
        return pa.Table.from_arrays(out, names=SCORED_NAMES)

    return run


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
SCORED_NAMES = [f.split()[0] for f in SCORED.split(", ")]


def score(docs: DataFrame, held_out, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every document;
    learned from the rows where the column ``held_out`` is false. A null or blank text is one end token.
    Repeated rows each count and are each scored. With no row to learn from all words are unknown."""
    with shuffles_cleared(docs.sparkSession):
        return _score(docs, held_out, doc, text)


def _score(docs: DataFrame, held_out, doc: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), held_out.alias("held_out"))
    held, length = F.coalesce("held_out", F.lit(True)), F.octet_length("text").cast("bigint")
    sizes = rows.agg(*[F.coalesce(F.sum(F.when(x, length)), F.lit(0)) for x in (~held, held)]).first()
    ranges = -(-max(sum(sizes) // SHARE + 1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(sizes) // LEAST + 1)) // SPLIT)
    blocks = ranges * SPLIT
    pairs = old = cut_lineage(rows.mapInArrow(_count(blocks), COUNTS).groupBy("bucket").applyInArrow(_start(blocks), MOVED))
    words, sweeps, fresh, model = _of(old, "count"), [], None, {"d0": 0.5}
    for sweep in range(BURN + SWEEPS):
        before, last = words, sweep == BURN + SWEEPS - 1
        moved = cut_lineage(before.union(_of(old, "ask")).groupBy("bucket").applyInArrow(_range(fresh, model["d0"], sweep), MOVED))
        words = _of(moved, "words")
        C0, tables, ones, twos, V, N, single = _sums(words, 7)
        if sweep == 0:
            model = {"N": N, "V": V, "d1": _discount(single, _sums(_of(old, "block"), 1)[0]), "d0": _discount(ones, twos)}
        else:
            dropped(before)
        fresh = (STRENGTH + model["d0"] * tables) / (model["V"] + 1)
        now = {**model, "C0": C0, "fresh": fresh, "sweep": sweep}
        sweeps += [now] * (sweep >= BURN)
        step = _of(old, "block").union(_of(moved, "told")).groupBy("bucket").applyInArrow(_sweep(now, blocks, sweep >= BURN, last), MOVED)
        pairs = cut_lineage(step)
        dropped(old)
        old = pairs
    hot = spark.sparkContext.broadcast(_hot(pairs))
    # held-out texts and others in groups of their own
    groups = [F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(min(blocks, x // LEAST), x // CHUNK) + 1)).cast("int") * 2 + k for k, x in enumerate(sizes)]
    grouped = rows.withColumn("part", F.when(held, groups[1]).otherwise(groups[0]))
    columns = ["doc_id", "held_out", "n_tokens", "n_known", F.lit(model["N"]).cast("bigint").alias("train_tokens"), "base_score", "score"]
    passes, scored = min(PASSES, sum(sizes) // (2 * CHUNK) + 1), []
    for k in range(passes):
        parts = grouped.where(F.pmod(F.shiftright("part", 1), F.lit(passes)) == k)
        ask = parts.groupBy("part").applyInArrow(_ask(ranges, hot), MOVED)
        told = ask.groupBy("bucket").cogroup(words.union(_of(pairs, "pairs")).groupBy("bucket")).applyInArrow(_answer, MOVED)
        out = parts.groupBy("part").cogroup(told.groupBy("bucket")).applyInArrow(_score_group(sweeps, ranges, hot), SCORED)
        scored.append(out.select(*columns))
    done = cut_lineage(*scored)
    dropped(words)
    dropped(pairs)
    return done


def _of(table: DataFrame, kind: str) -> DataFrame:
    """The rows that are that; the arrays that others have are not read."""
    other = "sent" if kind in ("block", "words", "pairs") else "kept"
    return table.where(F.col("kind") == kind).withColumn(other, F.lit(None).cast("array<binary>"))


def _sums(rows: DataFrame, n: int) -> tuple:
    return rows.agg(*[F.coalesce(F.sum(F.col("sums")[k]), F.lit(0)) for k in range(n)]).first()


def _hot(pairs: DataFrame) -> tuple[np.ndarray, ...]:
    """What pairs that make up over HOT_SHARE of all tokens differ by: at most 1 / HOT_SHARE of them."""
    rows = [r[0] for r in pairs.select("sent").collect()]
    hot = [_joined([r[k] for r in rows], kind) for k, kind in enumerate((np.uint64, np.float64, np.float64))]
    order = np.argsort(hot[0])
    return tuple(x[order] for x in hot)


def report(docs: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text"), id_remainder("doc_id", 10, 0))
