"""How many rows the last join of the Jaccard links makes in a group of near copies."""

import random

import numpy as np

from linref.llm import jaccard


def test_copies_changed_elsewhere_make_few_rows(spark, monkeypatch):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(240):
        own = list(words)
        for at in rnd.sample(range(150), 6):
            own[at] = f"x{i}_{at}"
        texts.append(" ".join(own))
    met = []
    enough = jaccard._enough
    monkeypatch.setattr(jaccard, "_enough", lambda rows, *more: (met.append(rows.count()), enough(rows, *more))[1])
    found = jaccard.component_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert met[-1] <= 240, met
    sets = [brute_set(t) for t in texts]
    first = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((first[i], first[j]))
                first = [a if x == b else x for x in first]
    assert [r["component_id"] for r in found] == first


def brute_set(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_sketches_differ_no_more_than_their_sets():
    rnd = np.random.default_rng(3)
    pool = rnd.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.sort(rnd.choice(pool, size, replace=False)) for size in (0, 1, 5, 60, 200, 390, 400)]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    parts = np.array([a.to_numpy().view(np.uint64) for a in jaccard._sketches(np.concatenate(sets), row, len(sets))]).T
    for a in range(len(sets)):
        for b in range(len(sets)):
            bits = sum(int(x).bit_count() for x in parts[a] ^ parts[b])
            assert bits <= len(np.setxor1d(sets[a], sets[b])) and (a != b or bits == 0)
