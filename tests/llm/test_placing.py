"""Sharding and mixing: laws, brute-force targets, edge cases."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from deltaloom.llm import mixing, sharding

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shard_rows(spark, rows, shards=24):
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    return [r.asDict() for r in sharding.balanced_shards(docs, shards).collect()]


def laws(rows, got, shards):
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) <= set(range(shards))
    assert max((counts[k] for k in range(shards)), default=0) - min((counts[k] for k in range(shards)), default=0) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards(spark):
    rows = [(i, f"text {i // 2 if i < 200 else i}", "x") for i in range(700)] + [(i, "hot", "x") for i in range(700, 1000)]
    rows += [(None, None, "n"), (1, None, "n"), (1, "text 0", "x"), (5, "", "e"), (6, "é" * 100_000, "l")]
    got = shard_rows(spark, rows)
    laws(rows, got, 24)
    again = shard_rows(spark, rows)
    assert sorted(map(str, got)) == sorted(map(str, again))
    pairs = defaultdict(set)
    for r in got:
        if r["doc_id"] is not None and 1 < r["doc_id"] < 200:
            pairs[r["text_crc32"]].add(r["shard"])
    assert sum(len(s) > 1 for s in pairs.values()) <= 5
    hot = Counter(r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"hot"))
    assert len(hot) <= 12  # 300 of 1005 rows fill 7.2 of 24 shards


def test_few_rows(spark):
    for rows in ([], [(1, "a", "x")], [(i, "same", "x") for i in range(5)]):
        laws(rows, shard_rows(spark, rows, 3), 3)


def brute_targets(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            goal |= share
            break
        for s in over:
            goal[s] = float(most * sizes[s])
            left -= goal[s]
        free -= set(over)
    return goal


def test_mix(spark):
    rows = []
    for s, n, w in (("a", 40, 30), ("b", 60, 7), ("c", 300, 11), ("Ä", 3, 5), ("d", 2, 1), (None, 50, 20), ("z", 80, 60)):
        rows += [(len(rows) + i, "w\t" * (1 + (w * (i + 3) * 7919) % (2 * w)), s, "x") for i in range(n)]
    rows += [(None, "a b c", "a", "x"), (3, rows[3][1], "a", "x"), (10_001, None, "a", "x"), (10_002, " \n", "b", "x"), (10_003, "w " * 20_000, "z", "long"), (10_004, None, "empty", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((i, s, len(WORDS.findall(t or ""))) for i, t, s, _ in rows)
    sizes = Counter()
    for r in got:
        sizes[r.source] += r["size"]
    goals = brute_targets(sizes, (5, 2, 1), 3)
    taken = Counter()
    for r in got:
        assert abs(r.target - goals[r.source]) < 1e-6 * max(1, r.target) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
    for s, goal in goals.items():
        assert abs(taken[s] - goal) <= (10_000 if s == "z" else max(0.03 * goal, 5)), (s, taken[s], goal)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(docs.limit(0)).count() == 0


def dense_rates(words, goals, ridge, most):
    """The dual solved at once by damped Newton steps over all multipliers; words: source by language."""
    k, m = words.shape
    share = words.sum(0) * goals.sum() / words.sum()
    x = np.zeros(k + m)

    def parts(x):
        raw = np.exp(x[:k, None] + x[k:])
        return raw, words * np.minimum(most, raw)

    def value(x):
        raw = np.exp(x[:k, None] + x[k:])
        own = np.where(raw < most, raw, most + most * np.log(np.maximum(raw, most) / most))
        return (words * own).sum() - goals @ x[:k] - share @ x[k:] + ridge / 2 * words.sum(0) @ x[k:] ** 2

    for _ in range(500):
        raw, got = parts(x)
        gradient = np.r_[got.sum(1) - goals, got.sum(0) - share + ridge * words.sum(0) * x[k:]]
        curve = np.where(raw < most, words * raw, 0)
        hessian = np.block([[np.diag(curve.sum(1)), curve], [curve.T, np.diag(curve.sum(0) + ridge * words.sum(0))]])
        step = -np.linalg.solve(hessian + 1e-9 * np.eye(k + m), gradient)
        size = 1.0
        while value(x + size * step) > value(x) and size > 1e-9:
            size /= 2
        x = x + size * step
        if np.abs(gradient).max() < 1e-9 * goals.sum():
            break
    return np.minimum(most, np.exp(x[:k, None] + x[k:]))


def test_rates_equal_a_dense_solver(spark):
    rng = np.random.default_rng(4)
    names, langs = ["a", "b", "c", "d", "e"], ["x", "y", None]
    words = rng.integers(50, 4000, (5, 3)) * np.array([[9, 1, 1], [1, 9, 1], [2, 2, 9], [1, 5, 1], [30, 1, 2]])
    sizes = spark.createDataFrame([(s, g, int(words[i, j])) for i, s in enumerate(names) for j, g in enumerate(langs)], "source string, lang string, words long")
    own = sizes.groupBy("source").sum("words").withColumnRenamed("sum(words)", "source_size")
    goals = mixing.targets(own, (5, 2, 1), 3)
    goal = {r.source: r.target for r in goals.collect()}
    rates = {(r.source, r.lang): r.rate for r in mixing.balanced(sizes, goals, 3, 60).collect()}
    got = np.array([[rates[s, g] for g in langs] for s in names])
    want = dense_rates(words, np.array([goal[s] for s in names]), mixing.RIDGE, 3)
    assert np.allclose(got, want, rtol=1e-3), (got, want)
    assert np.allclose((got * words).sum(1), [goal[s] for s in names], rtol=1e-6)
    tilt = got[np.array([goal[s] < 2.99 * words[i].sum() for i, s in enumerate(names)])]
    assert (tilt.max(1) / tilt.min(1)).max() > 1.05  # documents of one source have other rates in another language
    before, plain = words.sum(0) / words.sum(), (words * (np.array([goal[s] for s in names]) / words.sum(1))[:, None]).sum(0)
    off = lambda x: np.abs(x / x.sum() - before).sum()
    assert off((got * words).sum(0)) < 0.6 * off(plain)


def test_unsettled_rates_are_an_error(spark):
    sizes = spark.createDataFrame([("a", "x", 900), ("a", "y", 100), ("b", "x", 100), ("b", "y", 900), ("c", "x", 500), ("c", None, 0)], "source string, lang string, words long")
    own = sizes.groupBy("source").agg({"words": "sum"}).withColumnRenamed("sum(words)", "source_size")
    goals = mixing.targets(own, (5, 2, 1), 3)
    with pytest.raises(RuntimeError, match="not settled"):
        mixing.balanced(sizes, goals, 3, 1)
    assert mixing.balanced(sizes, goals, 3, 40).count() == 5
    assert mixing.balanced(sizes.where("words = 0"), goals, 3, 1).count() == 0


def test_repeats_are_taken_one_by_one(spark):
    rows = [(i % 40, f"{'w ' * (5 + i % 3)}{i}", "b" if i % 2 else "a", "en") for i in range(400)] + [(None, "w x y z", "a", None)] * 6
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    took = Counter()
    for r in mixing.mix(docs).collect():
        took[r.source] += r.taken
    got = Counter()
    for r in mixing.repeated(docs).collect():
        got[r.source] += len(WORDS.findall(r.text))
    assert got == took
