"""Plain versions of the operators, to hold results against on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text, fold=False):
    text = text or ""
    return WORD.findall(text.translate(UPPER) if fold else text)


def op2(docs, n=13):
    """docs: (doc_id, text) rows; as many results, in order."""
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in docs:
        w = words(t)
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, n=5):
    w = words(text, True)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def op7(docs, percent=75):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in by[x] if j > i)
        for j, o in shared.items():
            if 100 * o >= percent * (len(s) + len(sets[j]) - o):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))]


def op8_base(docs):
    train = [(d, t) for d, t in docs if zlib.crc32(str(d).encode()) % 7 != 2]
    counts = Counter(w for _, t in train for w in words(t, True))
    if train:
        counts["\n"] = len(train)
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in docs:
        tokens = [*words(t, True), "\n"]
        out.append((d, zlib.crc32(str(d).encode()) % 7 == 2, len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)))
    return out


def op6_edit(docs):
    order = sorted(docs)
    out = {}
    for i, (d, t) in enumerate(order):
        following, k = order[(i + 1) % len(order)][1], len(t) // 2
        edited = t[: len(t) - k] + following[:k]
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest())
    return out
