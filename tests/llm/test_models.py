"""Language identification and quality: exact inference, held-out accuracy, edge cases."""

from __future__ import annotations

import itertools
import os
import zlib

import numpy as np
import pytest

from deltaloom.llm import langid, quality

SF = "/root/testdata/sf0.01"
has_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    start, moves = rng.normal(size=3), rng.normal(size=(3, 3))
    sizes = np.array([1, 5, 7])
    scores = rng.normal(size=(13, 3))
    got = langid.marginals(scores, sizes, start, moves)
    at = 0
    for k, n in enumerate(sizes):
        total, mean = 0.0, np.zeros(3)
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.exp(start[path[0]] + sum(scores[at + i, s] for i, s in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            total += p
            np.add.at(mean, list(path), p / n)
        assert np.allclose(got[k], mean / total)
        at += n


@pytest.mark.parametrize("sizes", [[1], [48, 49, 1], [300, 2, 97, 48]])
def test_blocks_equal_one_pass(sizes):
    rng = np.random.default_rng(2)
    start, moves, scores = rng.normal(size=4), 2 * rng.normal(size=(4, 4)), 3 * rng.normal(size=(sum(sizes), 4))
    got = langid.marginals(scores, np.array(sizes), start, moves)
    for k, (a, n) in enumerate(zip(np.cumsum([0, *sizes]), sizes)):
        node, _ = langid.expected(scores[a : a + n], start, moves)
        assert np.allclose(got[k], node.mean(0))


@has_data
def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None), (10**6 + 1, " 12 !"), (None, "the of and"), (10**6 + 2, ""), (0, "the of the")], "doc_id long, text string")
    got = langid.languages(docs.unionByName(extra, allowMissingColumns=True).withColumn("score", docs["lang"])).collect()
    assert len(got) == docs.count() + 5
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = [r for r in got if r.held_out and r.doc_id in lang and r.doc_id]
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.98 * len(out) > 100
    assert {r.lang_pred for r in got if r.doc_id in (10**6, 10**6 + 1, 10**6 + 2)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.languages(docs.limit(0)).count() == 0


def test_code_switched_words():
    docs = [(langid.spans_of(f"{a} {b} the of and with " * 12, 1), "en") for a, b in zip("abcdefgh", "stuvwxyz", strict=True)]
    docs += [(langid.spans_of(f"{a} {b} der die und nicht " * 12, 1), "de") for a, b in zip("abcdefgh", "stuvwxyz", strict=True)]
    m = langid.learn(docs)
    words = ["the", "of", "x", "and", "with", "the", "of"] * 3 + ["der", "die", "x", "nicht", "und", "die"] * 3
    node, _ = langid.expected(m.emissions(words), m.start, m.moves)
    assert [m.languages[i] for i in node.argmax(1)] == ["en"] * 21 + ["de"] * 18


def test_all_letters_of_a_long_run_count():
    assert [len(w) for w in langid.LETTERS.findall("a" * 60 + " b2c")] == [24, 24, 12, 1, 1]
    model = langid.learn([([["abcd" * 6, "efgh"]], "x"), ([["zyxw" * 6, "vuts"]], "y")])
    row = lambda w: model.emissions(langid.LETTERS.findall(w)).sum(0).argmax()
    assert row("abcd" * 2 + "qqqq" * 8 + "abcd" * 9) == 0 and row("zyxw" * 2 + "qqqq" * 8 + "zyxw" * 9) == 1


def test_spans_come_from_the_whole_text():
    words = [f"{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(9000)]
    words = [w for w in words if langid.LETTERS.fullmatch(w)]
    own = [langid.spans_of(" ".join(words), seed) for seed in range(30)]
    assert all(len(s) == langid.SPANS and all(len(x) == langid.SPAN for x in s) for s in own)
    assert max(words.index(s[-1][-1]) for s in own) > 0.8 * len(words)
    assert langid.spans_of("one two", 1) == [["one", "two"]] and langid.spans_of("12", 1) == []


def test_lexicon_lists_words_of_two_documents():
    got = langid.lexicon_of([(["a", "b", "b"], 0), (["a", "c", "b"], 0), (["a"] * 9, 1)])
    assert got == {"a": (1,), "b": (0,)}  # a has two of its eleven uses in the first language


def test_filter_fills_null_languages_and_keeps_rows_without_labels(spark):
    rows = [(i, "the cat and the dog of the house " * 3, "en") for i in range(12)] + [(20 + i, "der Hund und die Katze nicht das Haus " * 3, "de") for i in range(12)]
    rows += [(50, "the dog and the cat", None), (51, "12 !", "en"), (52, None, None), (53, "x " * 40_000 + "the of and " * 30_000, None), (50, "die Katze und der Hund", None), (None, "the house", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(((r.doc_id, r.lang) for r in langid.in_some_language(docs).collect()), key=str)
    assert [x for x in got if x[0] not in range(50)] == [(50, "de"), (50, "en"), (53, "en"), (None, "en")] and len(got) == 28
    none = langid.in_some_language(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang"))
    assert sorted((r.doc_id for r in none.collect()), key=str) == sorted((d for d, t, _ in rows if t and t != "12 !"), key=str)


@has_data
def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    extra = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (None, "x"), (0, "again")], "doc_id long, text string")
    got = quality.scored(docs.unionByName(extra, allowMissingColumns=True).withColumn("score", docs["lang"]), labels).collect()
    assert len(got) == docs.count() + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth and r.doc_id]
    assert sum(a == b for a, b in out) >= 0.93 * len(out)
    assert quality.scored(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.scored(docs.limit(3), labels.limit(0)).collect()} == {0.5}


def test_trees_walk_like_a_row_at_a_time():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(400, 5)), rng.integers(0, 2, 400).astype(float)
    trees = quality.grow(x, y, trees=7, depth=3)
    for row, score in zip(x, trees.scores(x), strict=True):
        total = trees.base
        for f, c, leaf in zip(trees.features, trees.cuts, trees.leaves, strict=True):
            k = 0
            while k < 7:
                k = 2 * k + 1 + int(row[f[k]] > c[k])
            total += leaf[k - 7]
        assert np.isclose(score, 1 / (1 + np.exp(-total)))


def test_quality_equals_a_slow_version(spark):
    """Labels are averaged, repeated rows count once, each tree is walked a row at a time."""
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["alpha", "beta", "GAMMA!!", "1234", "\n", "x" * 40], rng.integers(1, 60))) for _ in range(120)] + ["", None, "long " * 60_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "another text of three")] * 400
    marks = [(i, i % 2) for i in range(0, 120)] + [(4, 1), (5, None), (None, 1), (900, 1)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    got = {(r.doc_id, r.held_out): (r.score, r.predicted) for r in quality.scored(docs.where("doc_id <> 3 OR text LIKE 'another%'"), labels).collect()}
    by_id = {i: t for i, t in rows}
    y = {}
    for i, q in marks:
        if i is not None and q is not None and i in by_id and zlib.crc32(str(i).encode()) % 5:
            y.setdefault(i, []).append(q)
    trees = quality.grow(np.array([quality.statistics(by_id[i]) for i in sorted(y)]), np.array([sum(y[i]) / len(y[i]) for i in sorted(y)], float))
    for (i, held), (score, predicted) in got.items():
        assert held == (zlib.crc32(str(i).encode()) % 5 == 0)
        x, total = quality.statistics(by_id[i]), trees.base
        for features, cuts, leaves in zip(trees.features, trees.cuts, trees.leaves, strict=True):
            node = 0
            while node < len(features):
                node = 2 * node + 1 + int(x[features[node]] > cuts[node])
            total += leaves[node - len(features)]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-9 and predicted == int(score >= 0.3)
    assert len(got) == len(by_id)
