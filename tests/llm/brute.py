"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def kept_words(docs, window=50):
    """{(doc_id, text): (n_words, n_removed, sha)} of word windows that start in a smaller document too."""
    inf = float("inf")
    first = {}
    split = {(i, t): WORD.findall(t or "") for i, t in docs}
    for (i, _), words in split.items():
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            first[key] = min(first.get(key, inf), inf if i is None else i)
    out = {}
    for (i, t), words in split.items():
        gone = set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < (inf if i is None else i):
                gone |= set(range(s, s + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[i, t] = len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()
    return out


def kept_bytes(docs, length=400):
    """{(doc_id, text): (n_bytes, n_removed, n_spans, sha)} of byte strings that start anywhere else too; docs is a list of rows."""
    seen = defaultdict(int)
    for _, t in docs:
        raw = (t or "").encode()
        for s in range(len(raw) - length + 1):
            seen[raw[s : s + length]] += 1
    out = {}
    for i, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if seen[raw[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[i, t] = len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()
    return out


def shingles(text, k=4):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def near_components(docs, percent=80):
    """{doc_id: (n_shingles, component)} with links of at least ``percent`` Jaccard between full sets."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    pairs = {(a, b) for group in holders.values() for a in group for b in group if a < b}
    for a, b in pairs:
        inter = len(sets[a] & sets[b])
        if 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}
