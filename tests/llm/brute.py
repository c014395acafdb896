"""Plain Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(docs, n=4, percent=85):
    s = [(d, sets(t, n)) for d, t in docs]
    root = list(range(len(s)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            a, b = s[i][1], s[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for i, (d, _) in enumerate(s):
        if d is not None:
            least[find(i)].append(d)
    return sorted(((d, len(x), min(least[find(i)], default=None) if x else d) for i, (d, x) in enumerate(s)), key=str)


def contamination(docs, items, window=10):
    wins = defaultdict(set)
    for i, t in items:
        w = TERM.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[k : k + window])].add("" if i is None else str(i))
    sizes = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w, hit, found = TERM.findall((t or "").translate(LOWER)), set(), set()
        for k in range(len(w)):
            for n in sizes:
                if k + n <= len(w) and tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def kept_words(docs, window=35):
    words = [WORD.findall(t or "") for _, t in docs]
    n = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(docs, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if n[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((d, " ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
    return sorted(out, key=str)


KINDS = [
    ("assign", re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]


def base_spans(text):
    found = sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(KINDS) for m in p.finditer(text or "") if len(m.group(g)) >= least)
    return [(KINDS[k][0], a, b) for a, k, b in found]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
