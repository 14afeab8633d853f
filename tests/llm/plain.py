"""Brute-force versions of the corpus operators, for small tables."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import combinations

# The patterns the contract states.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def words(text):
    return [w.decode("utf-8", "replace") for w in (text or "").encode().lower().split()]


def shingles(text, n):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def components(ids, links):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def similar(sets, percent):
    """Pairs of keys whose sets are similar enough, by an inverted index of all members."""
    index = defaultdict(list)
    for key, members in sets.items():
        for m in members:
            index[m].append(key)
    pairs = {p for keys in index.values() for p in combinations(sorted(keys), 2)}
    return [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(text):
    def holds(kind, match):
        digits = re.sub("[^0-9]", "", match)
        if kind == "ip":
            return all(int(p) <= 255 for p in match.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and luhn(digits)
        return kind != "phone" or 8 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


def overlaps(docs, items, window=10):
    """For each document (n_words, n_hit, sorted item ids) by comparing every window."""

    def cut(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))

    out = {}
    for doc, text in docs:
        w, hit, found = cut(text), set(), set()
        for item, passage in items:
            p = cut(passage)
            n = min(window, len(p))
            for k in range(len(p) - n + 1 if n else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == p[k : k + n]:
                        hit.update(range(at, at + n))
                        if item is not None:
                            found.add(str(item))
        out[doc] = (len(w), len(hit), sorted(found))
    return out
