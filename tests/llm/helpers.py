"""Plain restatements of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words((text or "").translate(str.maketrans(UPPER, LOWER)))
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components(docs):
    """doc_id -> (number of shingles, smallest linked doc_id)."""
    sets = {i: shingles(t) for i, t in docs}
    least = {i: i for i in sets}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def without_repeats(docs, size=50):
    first = {}
    for i, text in docs:
        w = words(text)
        for p in range(len(w) - size + 1):
            key = tuple(w[p : p + size])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, text in docs:
        w = words(text)
        gone = {q for p in range(len(w) - size + 1) if first[tuple(w[p : p + size])] < i for q in range(p, p + size)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def text_of(rng, n, vocabulary=5000):
    return " ".join(f"w{int(x)}" for x in rng.integers(0, vocabulary, n))


def edited(rng, text, n):
    w = text.split(" ")
    for p in rng.choice(len(w), n, replace=False):
        w[int(p)] = f"e{int(rng.integers(0, 10**9))}"
    return " ".join(w)
