from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from deltaloom.llm import ngram_join as nj
from deltaloom.llm.common import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text, k):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    sets = [sets_of(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ids = [i for i, (d, _) in enumerate(rows) if d is not None and sets[i]]
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[top(a)] = top(b)
    least = {}
    for i in ids:
        least[top(i)] = min(least.get(top(i), rows[i][0]), rows[i][0])
    return Counter((d, len(sets[i]), least.get(top(i), d) if i in set(ids) else d) for i, (d, _) in enumerate(rows))


def near_copies(rng, words, n, most):
    base = [rng.choice(words) for _ in range(rng.choice([12, 60, 150]))]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, most)):
            own[rng.randrange(len(own))] = rng.choice(words)
        yield " ".join(own)


@pytest.mark.parametrize(("k", "percent", "rounds", "wide"), [(4, 85, 3, 2048), (5, 80, 0, 9), (2, 70, 1, 2048), (2, 70, 0, 3)])
def test_components_equal_brute_force(spark, monkeypatch, k, percent, rounds, wide):
    monkeypatch.setattr(nj, "ROUNDS", rounds)
    monkeypatch.setattr(nj, "WIDE", wide)
    monkeypatch.setattr(nj, "BLOCK", 5)
    monkeypatch.setattr(nj, "PART", 3)
    rng = random.Random(k)
    words = [f"w{i}" for i in range(400)]
    texts = [t for _ in range(6) for t in near_copies(rng, words, 8, 3)] + list(near_copies(rng, words, 60, 9))
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    texts += ["", None, " \t", "One", "one", "ONE two", "a b c", "a b c d", "É x", "é x", "w " * 3000, "w " * 2000, " ".join(words * 10), " ".join(words * 10) + " end"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (4, "other text of a repeated id"), (None, texts[0]), (None, None)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, node int, kind int")
    got = Counter(tuple(r) for r in nj.similar(docs, k, percent).collect())
    assert got == brute(rows, k, percent)


def test_empty(spark):
    assert nj.similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_pair_at_the_threshold_meets():
    rng = np.random.default_rng(5)
    for percent in (80, 85):
        for n in (1, 2, 3, 5, 6, 7, 11, 20, 40, 99, 400):
            for m in range(-(-n * percent // 100), n + 1):
                both = -(-percent * (n + m) // (100 + percent))
                if both > m:
                    continue
                every = rng.integers(1, 2**64, n + m - both, dtype=np.uint64)
                a, b = np.unique(every[:n]), np.unique(np.r_[every[:both], every[n:]])
                assert set(nj.band_keys(a, percent)) & set(nj.band_keys(b, percent)), (percent, n, m)


def test_graph_components(spark):
    edges = [(1, 2), (3, 2), (5, 5), (9, 8), (8, 7), (7, 6), (6, 10), (20, 21)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 600 + i) for i in range(50)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got[1] == got[2] == got[3] == 1 and 5 not in got and {got[x] for x in (6, 7, 8, 9, 10)} == {6}
    assert {got[100 + i] for i in range(41)} == {100} and {got[600 + i] for i in range(50)} == {500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketch_distance_never_exceeds_the_symmetric_difference():
    rng = np.random.default_rng(5)
    for _ in range(200):
        both, left, right = (rng.integers(0, 1 << 63, rng.integers(0, most), dtype=np.uint64) for most in (900, 200, 2000))
        x, y = (np.unique(np.r_[both, own, np.uint64(1)]) for own in (left, right))
        distance = nj.distance(nj.whole_sketch(x), nj.whole_sketch(y))
        assert distance == nj.distance(nj.whole_sketch(y), nj.whole_sketch(x)) <= len(np.setxor1d(x, y))
