"""Brute-force versions that the tests share."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import xxhash


def dedup_texts(rows, least=40, most=5):
    """The kept text of each id (ids are distinct)."""
    return {i: t for i, _, _, t in _deduped(rows, least, most)}


def dedup_by_hand(rows, least=40, most=5):
    return Counter((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in _deduped(rows, least, most))


def _deduped(rows, least, most):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(holders[key(x)]) < most or i == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def fingerprint_by_hand(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(rows, budget=4):
    distinct = sorted({f for _, f in rows})
    up = {f: f for f in distinct}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    array = np.array(distinct, np.uint64)
    for i, f in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= budget):
            up[root(distinct[i + 1 + j])] = root(f)
    least = {}
    for i, f in rows:
        least[root(f)] = min(i, least.get(root(f), i))
    return {(i, f): least[root(f)] for i, f in rows}
