"""Plain single-machine versions of the operators' contracts, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def quality(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            covered.update(range(i, i + 5))
    lines = [s for s in (text or "").split("\n") if WORD.search(s)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def suffix_dedup(docs, k=100):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256 of the rest)}; docs: [(doc_id, text)]."""
    seen, out = set(), {}
    for d, text in sorted(docs):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - k + 1):
            w = b[i : i + k]
            if w in seen:
                gone[i : i + k] = True
            else:
                seen.add(w)
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def shingles(text, n):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(docs, n, num, den):
    """{doc_id: (set size, component)}"""
    sets = {d: shingles(t, n) for d, t in docs}
    have = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            have[x].add(d)
    links = set()
    for d, s in sets.items():
        n_common = Counter(e for x in s for e in have[x] if e > d)
        links.update((d, e) for e, c in n_common.items() if den * c >= num * (len(s) + len(sets[e]) - c))
    comp = components(sets, links)
    return {d: (len(sets[d]), comp[d]) for d in sets}


def fold(doc_id, m):
    return zlib.crc32(str(doc_id).encode()) % m
