"""Plain versions of the operators for small fixtures."""

import hashlib
import re

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def exact(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(SPACE.sub(b" ", (t or "").encode()), []).append(i)
    return {i: (min(g), len(g), i == min(g), hashlib.sha256(k).hexdigest()) for k, g in groups.items() for i in g}


def substring(docs, window=50):
    words = {i: WORD.findall((t or "").encode()) for i, t in docs}
    first = {}
    for i, w in words.items():
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def simhash(text, shingle=3):
    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m.group(0).lower(), (text or "").encode()))
    if not w:
        return 0
    s = [b" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, linked):
    """Smallest id reachable, by repeated passes over all pairs."""
    c = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if linked(a, b) and c[a] != c[b]:
                    c[a] = c[b] = min(c[a], c[b])
                    changed = True
    return c


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
        row = new
    return row[-1]
