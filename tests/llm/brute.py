"""Plain versions of the operators, for small inputs."""

import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
KEY = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
SECRETS = (("assign", rf"""({KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def components(rows, size, similarity=80):
    """rows: (doc_id, text); the smallest doc_id reachable, by position."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= similarity * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return [None if doc is None else low[find(i)] for i, (doc, _) in enumerate(rows)], [len(s) for s in sets]


def without_repeats(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                keep[i : i + window] = [False] * window
        out.append((len(w), [x for x, k in zip(w, keep) if k]))
    return out


def secrets(text):
    spans = [(m.start(), k, name, m.end()) for k, (name, pattern, group, least) in enumerate(SECRETS) for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    return sorted(spans)


def targets(sizes, weights=(5, 2, 1), most=3):
    """sizes by source -> target by source, by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode("utf-16-be", "surrogatepass") if s else b""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        share = {s: (total - sum(fixed.values())) * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s] or not sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: float(most * sizes[s]) for s in over}
