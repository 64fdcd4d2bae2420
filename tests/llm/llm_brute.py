"""Plain versions of the operators, over lists of (doc_id, text)."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WS = re.compile(rb"[\x20\x09-\x0D]+")


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def raw(text) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def covered(sequences, length):
    """For each sequence, which of its symbols a window that starts earlier too covers."""
    seen, out = set(), []
    for s in sequences:
        c = bytearray(len(s))
        for i in range(len(s) - length + 1):
            k = s[i : i + length] if isinstance(s, bytes) else tuple(s[i : i + length])
            if k in seen:
                c[i : i + length] = b"\1" * length
            seen.add(k)
        out.append(c)
    return out


def covered_windows(sequences, length):
    """``(sequence, offset)`` of the windows that start earlier too."""
    seen, out = set(), []
    for i, s in enumerate(sequences):
        for j in range(len(s) - length + 1):
            k = s[j : j + length] if isinstance(s, bytes) else tuple(s[j : j + length])
            if k in seen:
                out.append((i, j))
            seen.add(k)
    return out


def substring(rows, length=100):
    rows = sorted(rows)
    texts = [raw(t) for _, t in rows]
    out = {}
    for (d, _), s, c in zip(rows, texts, covered(texts, length)):
        spans = sum(1 for i in range(len(c)) if c[i] and not (i and c[i - 1]))
        out[d] = (len(s), sum(c), spans, sha(bytes(b for b, x in zip(s, c) if not x)))
    return out


def word_windows(rows, length=20):
    rows = sorted(rows)
    words = [raw(t).split() for _, t in rows]
    return {d: (len(w), sum(c), sha(b" ".join(x for x, y in zip(w, c) if not y))) for (d, _), w, c in zip(rows, words, covered(words, length))}


def lines(rows, chars=20, docs=3):
    holders, largest = defaultdict(set), {}
    keyed = {}
    for d, t in rows:
        keyed[d] = [(x, x.strip(" \t\n\v\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for x in (t or "").split("\n")]
        for _, k in keyed[d]:
            holders[k].add(d)
            largest[k] = max(largest.get(k, d), d)
    out = {}
    for d, pairs in keyed.items():
        kept = [x for x, k in pairs if not (len(k) >= chars and len(holders[k]) >= docs and largest[k] != d)]
        out[d] = (len(pairs), len(pairs) - len(kept), "\n".join(kept))
    return out


def simhash(text, words=3, seed=42):
    w = raw(text).lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, seed)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


class Union(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def components(prints: dict, near):
    """The smallest id reachable of each id; ``near(a, B)``: which rows of the matrix B are linked to a."""
    ids = sorted(prints)
    m = np.array([prints[d] for d in ids], np.uint64).reshape(len(ids), -1)
    u = Union()
    for i, d in enumerate(ids):
        u.find(d)
        for j in np.flatnonzero(near(m[i], m[i + 1 :])):
            u.join(d, ids[i + 1 + j])
    return {d: u.find(d) for d in ids}


def exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[WS.sub(b" ", raw(t))].append(d)
    return {d: (min(g), len(g), d == min(g), sha(k)) for k, g in groups.items() for d in g}


def top(vectors, k=10):
    whole = {i: np.floor(1024 * np.asarray(v, float)).astype(int) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in whole if i % 100 == 0):
        scored = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return out


def best_padding(lengths, buckets):
    """Least total padding, by trying all bounds."""
    from itertools import combinations

    distinct, best = sorted(set(lengths)), None
    n = min(buckets, len(distinct))
    counts = Counter(lengths)
    for bounds in combinations(distinct[:-1], n - 1):
        bounds = [*bounds, distinct[-1]]
        cost = sum(c * (next(b for b in bounds if b >= x) - x) for x, c in counts.items())
        best = cost if best is None else min(best, cost)
    return best
