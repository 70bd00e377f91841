"""Plain-Python versions of the operators' results, for comparison."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return (text or "").encode().lower().split()


def rest(doc_id, mod):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod


def lm_base(rows):
    """rows: (doc_id, text) -> sorted (doc_id, held_out, n_tokens, n_known, train_tokens, base_score)."""
    counts = Counter()
    for i, t in rows:
        if rest(i, 5) != 1:
            counts.update([*words(t), "end"])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        w = [*words(t), "end"]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        out.append((i, rest(i, 5) == 1, len(w), sum(counts[x] > 0 for x in w), n, base))
    return out


def shingles(text, width):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1)))


def near_components(rows, width, pct=80):
    """Per row: (set size, smallest doc_id reachable)."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= pct * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(len(s), i if not s else least.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def dedup_lines(docs, min_words):
    """docs: {doc_id: text} -> {doc_id: text}; all runs of min_words words, by brute force."""
    first, runs = {}, []
    for i in sorted(docs):
        lines = [(k, x) for k, x in enumerate(docs[i].split("\n")) if WORD.search(x)]
        for s in range(len(lines)):
            for e in range(s, len(lines)):
                if sum(len(WORD.findall(x)) for _, x in lines[s:e + 1]) >= min_words:
                    run = tuple(x for _, x in lines[s:e + 1])
                    first.setdefault(run, (i, s))
                    runs.append((i, s, run, range(lines[s][0], lines[e][0] + 1)))
    gone = {i: set() for i in docs}
    for i, s, run, at in runs:
        if first[run] != (i, s):
            gone[i].update(at)
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in docs.items()}


def edited(texts_by_id):
    ids = sorted(texts_by_id, reverse=True)
    out = {}
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        t, after = texts_by_id[a], texts_by_id[b]
        half = len(t) // 2
        out[a] = hashlib.sha256((t[:len(t) - half] + after[:half]).encode()).hexdigest()
    return out


def top_k(vectors, k, every):
    """vectors: [(id, list)] -> {(query, rank): (id, score)}, equal lengths."""
    x = np.floor(256 * np.array([v for _, v in vectors], float)).astype(np.int64)
    ids = [i for i, _ in vectors]
    out = {}
    for q, i in enumerate(ids):
        if i % every == 0:
            best = sorted((-int(s), j) for s, j in zip(x @ x[q], ids, strict=True) if j != i)[:k]
            for r, (s, j) in enumerate(best, 1):
                out[i, r] = (j, -s)
    return out


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = float(cap * sizes[s])
            open_.remove(s)
        left = share * sum(sizes.values()) - sum(out.values())
    return out


def seats(votes, n):
    """Sainte-Lague, one seat at a time."""
    got = [0] * len(votes)
    for _ in range(n):
        k = max(range(len(votes)), key=lambda j: (votes[j] / (2 * got[j] + 1), -j))
        got[k] += 1
    return got
