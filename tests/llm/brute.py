"""Brute-force versions that the operators are held against."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def near_duplicates(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    common = Counter()
    for h in holders.values():
        for x in range(len(h)):
            for y in range(x):
                common[h[y], h[x]] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def deduplicated(rows, length=100):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            g = data[s : s + length]
            if g in first and first[g] != (i, s):
                gone[s : s + length] = b"\1" * length
            else:
                first[g] = (i, s)
        kept = bytes(c for c, x in zip(data, gone, strict=True) if not x)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def discounts(n):
    out = [0.0, 0.5, 1.0, 1.5]
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2 * n[1])
        for k in (1, 2, 3):
            if n[k - 1] and 0 < (d := k - (k + 1) * y * n[k] / n[k - 1]) < k:
                out[k] = d
    return out


def model(rows):
    """(P(v | u), token counts) of the rows (id, text, training) that are trained on."""
    pairs, tokens = Counter(), Counter()
    for _, t, train in rows:
        if train:
            w = [*words(t), "END"]
            tokens.update(w)
            pairs.update(zip(["START", *w], w, strict=False))
    context, kinds, before = Counter(), defaultdict(Counter), Counter()
    for (u, v), c in pairs.items():
        context[u] += c
        kinds[u][min(c, 3)] += 1
        before[v] += 1
    d = discounts([sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)])
    e = discounts([sum(c == k for c in before.values()) for k in (1, 2, 3, 4)])
    total, vocabulary = len(pairs), len(tokens)
    g1 = sum(e[min(c, 3)] for c in before.values()) / total if total else 1.0

    def p1(v):
        return (max(before[v] - e[min(before[v], 3)], 0) / total if total else 0) + g1 / (vocabulary + 1)

    def p(u, v):
        if not context[u]:
            return p1(v)
        return max(pairs[u, v] - d[min(pairs[u, v], 3)], 0) / context[u] + sum(d[k] * kinds[u][k] for k in (1, 2, 3)) / context[u] * p1(v)

    return p, tokens


def kneser_ney(rows):
    """{id: (n_tokens, n_known, train tokens, base, score)} of (id, text, training)."""
    p, tokens = model(rows)
    n, vocabulary = sum(tokens.values()), len(tokens)
    out = {}
    for i, t, _ in rows:
        w = [*words(t), "END"]
        out[i] = (len(w), sum(tokens[x] > 0 for x in w), n, sum(math.log10((tokens[x] + 1) / (n + vocabulary + 1)) for x in w), sum(math.log10(p(u, v)) for u, v in zip(["START", *w], w, strict=False)))
    return out


def subsequence_kernel(x, y, span, decay):
    """Sum over all subsequences of three bytes that both words hold, each weighted by its spans in both, over the words' norms."""

    def spread(word):
        w, out = b" " + word.translate(LOWER) + b" ", defaultdict(float)
        for i in range(len(w)):
            for k in range(i + 2, min(len(w), i + span + 1)):
                for j in range(i + 1, k):
                    out[w[i], w[j], w[k]] += decay ** (k - i)
        return out

    def norm(word):
        return math.sqrt(sum(max(len(word) + 2 - h, 0) * (h - 1) * decay ** (2 * h) for h in range(2, span + 1)))

    a, b = spread(x), spread(y)
    return sum(v * b[k] for k, v in a.items() if k in b) / (norm(x) * norm(y))
