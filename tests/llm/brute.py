"""Brute-force versions of the training-data operators, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def shingles(text, k=5):
    w = WORD.findall(lower(text))
    if len(w) >= k:
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return {tuple(w)} if w else set()


def near(docs, similar=75):
    """``{id: (n_shingles, component)}`` by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in docs}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    by = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    pairs = {(a, b) for ids in by.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    for a, b in pairs:
        x, y = sets[a], sets[b]
        if 100 * len(x & y) >= similar * len(x | y):
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeats(docs, match=100):
    """``{id: (n_bytes, n_removed, n_spans, sha256)}``, reading positions in order."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - match + 1):
            g = hashlib.blake2b(b[k : k + match], digest_size=12).digest()
            if g in seen:
                gone[k : k + match] = b"\x01" * match
            else:
                seen.add(g)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
