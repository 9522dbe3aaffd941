from __future__ import annotations

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from deltaloom.llm import codes, tokencounts, whitening
from deltaloom.llm.queries import tokenizer_path

WORDS = tokenizer_path("word_bpe_49k.json")
VECTORS = "vec_id long, embedding array<float>, label int, row string, x int, v double, weight long"


def library(path=WORDS):
    t = Tokenizer.from_file(path)
    return lambda text: len(t.encode(text or "", add_special_tokens=False))


# Token counts


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85\xa0　'<|>ΣσİéÉ́aAsSt19")), max_size=60))
def test_runs_between_white_space_are_independent(text):
    whole = library.__dict__.setdefault("whole", library())
    assert sum(whole(w.decode()) for w in text.encode().split()) == whole(text)
    cache = library.__dict__.setdefault("cache", tokencounts.Cache(WORDS, letters=True))
    assert sum(map(cache.length, text.encode().split())) == whole(text)


def test_slices_end_at_white_space_and_lose_nothing(monkeypatch):
    monkeypatch.setattr(tokencounts, "SLICE", 10)
    for text in (b"", b"a", b"ab cd" * 9, b"x" * 100, b" " * 50, b"aaaaaaaaaaaaaa\nb" * 5):
        parts = list(tokencounts.slices(text))
        assert b"".join(parts) == text
        assert [w for p in parts for w in p.split()] == text.split()


def test_counts_equal_the_library(spark):
    rng = random.Random(5)
    words = ["the", "The", "it's", "<|endoftext|>", "Ünïcode", "日本語テキスト", "x" * 90, "3.1415", "naïve,", " ", "é"] + [f"w{rng.random()}" for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(60))) for _ in range(200)] + [None, "", " \n\t ", "word " * 300_000, "z" * 200_000, "<|startoftext|>hot<|endoftext|>"]
    rows = [(i if i % 7 else None, t, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, words int")
    got = tokencounts.counted(docs, WORDS, limit=100).collect()
    whole = library()
    want = [(r[0], len((r[1] or "").encode()), whole(r[1]), whole(r[1]) > 100) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokencounts.counted(docs.limit(0), WORDS).collect() == []


def test_other_vocabularies_are_encoded_whole(spark):
    docs = spark.createDataFrame([(1, " a  b the cat"), (2, None), (3, "a\nb")], "doc_id long, text string")
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        size = tokencounts.whole_text_length(tokenizer_path(name))
        assert tokencounts.form(tokenizer_path(name)) == (False, False)
        assert {r.doc_id: r.n_tokens for r in tokencounts.counted(docs, tokenizer_path(name)).collect()} == {1: size(" a  b the cat"), 2: size(""), 3: size("a\nb")}
    assert tokencounts.form(WORDS) == (True, True)


def test_small_tables_and_caches_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(tokencounts, "CACHE", 3)
    cache = tokencounts.Cache(WORDS, letters=True)
    whole = library()
    words = [f"word{i % 9}x{i % 5}" for i in range(200)] + ["Word,", "WORD", "word's", "don't,", "a.b", "end...", "<|endoftext|>", "x<|startoftext|>,", "Supercalifragilistic!?"]
    assert [cache.length(w.encode()) for w in words] == [whole(w) for w in words]
    assert len(cache.young) <= 3


# Codes


def brute_codes(rows):
    kept = [(r[0], [int(np.floor(float(x) * 1024)) for x in r[1]], r[2]) for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    d = len(kept[0][1]) // 4
    part = lambda x, p: x[p * d : (p + 1) * d]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    books = [[part(r[1], p) for r in kept[:256]] for p in range(4)]
    near = lambda x, p: min((apart(x, e), i) for i, e in enumerate(books[p]))
    for _ in range(4):
        following = []
        for p in range(4):
            groups = {}
            for r in kept:
                groups.setdefault(near(part(r[1], p), p)[1], []).append(part(r[1], p))
            following.append([[sum(c) // len(groups[i]) for c in zip(*groups[i], strict=True)] if i in groups else e for i, e in enumerate(books[p])])
        books = following
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, x, label in kept:
        found = [near(part(x, p), p) for p in range(4)]
        out.append([i, label, "".join(f"{n:02x}" for _, n in found), sum(a for a, _ in found)])
    return sorted(((i, label, code, e, sum(o[3] for o in out if o[1] == label), sha) for i, label, code, e in out), key=str)


def vectors(rng, n, copies=0, scale=1.0):
    v = [np.float32(rng.normal(size=8) * scale).tolist() for _ in range(n)]
    return v + [v[0]] * copies


@pytest.mark.parametrize(("n", "copies", "scale"), [(5, 0, 0.1), (300, 150, 0.02), (330, 3, 30000.0)])
def test_codes_equal_a_slow_version(spark, n, copies, scale):
    rng = np.random.default_rng(n)
    rows = [(i * 3 % 1000, v, [0, 1, None, 0][i % 4]) for i, v in enumerate(vectors(rng, n, copies, scale))]
    rows += [(7, None, 1), (8, [1.0, None] * 4, 1), (9, [float("nan")] * 8, None), (11, [float("inf")] * 8, 0), (None, rows[0][1], None), (6, rows[1][1], 0), (6, rows[1][1], 0)]
    df = spark.createDataFrame([(*r, "r", 1, 2.0, 3) for r in rows], VECTORS)
    if scale > 1000:  # beyond the range each integer counts as the largest
        rows = [(i, None if v is None else [None if x is None else x if not np.isfinite(x) else max(-16384.0, min(16384.0, x)) for x in v], g) for i, v, g in rows]
    got = sorted(map(tuple, codes.coded(df).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)
    assert got == brute_codes(rows)


def test_codes_of_heavy_parts_join_as_light_ones(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, v, i % 3) for i, v in enumerate(vectors(rng, 40, 80, 0.1))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(codes, "SHARE", 3)
    monkeypatch.setattr(codes, "SENT_ROWS", 0)
    got = sorted(map(tuple, codes.coded(df).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)
    assert got == brute_codes(rows)


def test_codes_of_odd_lengths_and_of_nothing(spark):
    rows = [(1, [1.0] * 8, 0), (2, [2.0] * 8, 0), (3, [1.0] * 4, 0), (4, [], 0), (5, [1.0] * 7, 0), (6, [1.0] * 7, 0), (7, [1.0] * 7, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(r.vec_id for r in codes.coded(df).collect()) == [1, 2]
    assert codes.coded(df.where("vec_id > 3")).collect() == []
    assert codes.coded(df.limit(0)).collect() == []


# Whitening


def test_remainders_give_the_scatter_back():
    rng, moduli = random.Random(1), whitening.primes()
    assert len(set(moduli)) == 6 and all(2**20 < p < 2**21 for p in moduli)
    for x in [0, 1, -1, 2**120, -(2**120), *(rng.randrange(-(2**124), 2**124) for _ in range(50))]:
        assert whitening.remaindered([x % p for p in moduli], moduli) == x


@pytest.mark.parametrize(("n", "d", "scale"), [(150, 40, 1.0), (60, 5, 1e4), (9, 20, 1.0)])
def test_whitened_values_by_exact_arithmetic(spark, n, d, scale):
    rng = np.random.default_rng(d)
    data = np.float32(rng.normal(size=(n, d)) * scale * np.linspace(1, 3, d))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(data)] + [(5000, None, 1), (5001, [None] * d, 1), (5002, [float("nan")] * d, 0), (None, data[0].tolist(), None), (3, data[1].tolist(), 0)]
    df = spark.createDataFrame([(*r, "r", 1, 2.0, 3) for r in rows], VECTORS)
    x = [[int(np.floor(float(c) * 64)) + 1_000_000 for c in r[1]] for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    ids = [r[0] for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    m, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = [[Fraction(c) - Fraction(s, m) for c, s in zip(r, sums, strict=True)] for r in x]
    cov = np.array([[float(sum(r[i] * r[j] for r in centred) / m) for j in range(d)] for i in range(d)])
    got = whitening.whitened(df).collect()
    k = min(32, d, m - 1 - 2)  # two rows are repeated
    assert len(got) == m * k
    values = np.linalg.eigvalsh(cov)[::-1]
    by_row = {}
    for r in got:
        assert r.n == m and r.identity_error < 1e-6
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) < 1e-9
        by_row.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    want = sorted((str(i), sum((m * c - s) ** 2 for c, s in zip(r, sums, strict=True))) for i, r in zip(ids, x, strict=True))
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == want
    projected = np.linalg.eigh(cov)[1][:, ::-1][:, :k]
    truth = {}
    for i, r in zip(ids, centred, strict=True):
        truth.setdefault(str(i), []).append(np.array([float(v) for v in r]) @ projected / np.sqrt(values[:k]))
    for (i, _), c in by_row.items():
        v = np.array([c[j][0] for j in range(1, k + 1)])
        assert min(np.abs(np.abs(v) - np.abs(t)).max() for t in truth[str(i)]) < 1e-5


def test_whitening_beyond_longs_and_without_variance(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    got = whitening.whitened(df).collect()
    assert {r.component for r in got} == {1} and {r.deviation for r in got if r.vec_id != 3} == {None}  # the other variance is below the rounding error
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0])], "vec_id long, embedding array<double>")
    for rows in (same, same.limit(1), same.limit(0), same.where("false")):
        assert whitening.whitened(rows).collect() == []
    two = spark.createDataFrame([(None, [1.0, 2.0]), (None, [3.0, 2.0]), (4, [])], "vec_id long, embedding array<double>")
    assert sorted(round(r.whitened, 9) for r in whitening.whitened(two).collect()) == [-1.0, 1.0]
