from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from deltaloom.llm import langid, ngram_join, pieces  # noqa: E402
from tests.llm.test_ngram_join import sets_of  # noqa: E402

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    import sentencepiece

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows = corpus_pipeline.run(spark, SF).collect()
    model = langid.learn(langid.sample(spark.read.parquet(f"{SF}/documents.parquet")))

    def share(text):
        words = langid.LETTERS.findall((text or "").lower())
        return langid.expected(model.emissions(words), model.start, model.moves)[0].mean(0).max() if words else 0

    kept = [(d, t, s) for d, t, s in docs if share(t) >= 0.5]
    first = {}
    for d, t, s in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t), (d, t, s))
    kept = sorted(first.values())
    sets = {d: sets_of(t, 5) for d, t, _ in kept}
    root = {d: d for d in sets}
    top = lambda x: x if root[x] == x else top(root[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    kept = {d: (t, s) for d, t, s in kept if top(d) == d}
    copies = Counter(r.doc_id for r in rows)
    assert set(copies) <= set(kept) and max(copies.values()) <= 3
    size = {d: len(WORDS.findall(t)) for d, (t, _) in kept.items()}
    from tests.llm.test_placing import brute_targets

    own = Counter()
    for d, (_, s) in kept.items():
        own[s] += size[d]
    goals, taken, most = brute_targets(own, (5, 2, 1), 3), Counter(), Counter()
    for d, (_, s) in kept.items():
        taken[s] += copies[d] * size[d]
        most[s] = max(most[s], size[d])
    assert all(abs(taken[s] - g) <= max(0.1 * g, 0.6 * most[s]) for s, g in goals.items())
    lib = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.tokenizer_path())
    for r in rows:
        ids = lib.encode(kept[r.doc_id][0], add_bos=True, add_eos=True)
        assert list(r.ids) == ids and r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_stages_keep_columns_and_clean_rows(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat with the hat", "en", "a", 35, "x"), (2, None, None, None, None, "y"), (3, " 12 ", "en", "b", 4, "z"), (4, "le chat est sur la table avec un chapeau", "fr", "b", 40, "x"), (None, "no id here but words", "en", "a", 20, "n")], "doc_id long, text string, lang string, source string, n_chars long, row string")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row"]
        assert sorted((r.doc_id for r in docs.collect()), key=str) == [1, 4, None]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_long_texts_ties_and_repeated_rows(spark):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(17_000))
    rows = [(1, long, "en", "a"), (2, long + " end", "en", "a"), (3, "same text of three rows", "en", "b"), (3, "same text of three rows", "en", "b"), (4, "same  text of three rows", "en", "c"), (5, "a text of its own, with a null language", None, None), (6, "", "en", "a"), (6, "another text of the id six", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "")
        ids = sorted(r.doc_id for r in docs.collect())
        assert ids == {"language": [1, 2, 3, 3, 4, 5, 6], "exact_dedup": [1, 2, 3, 5, 6], "near_dedup": [1, 3, 5, 6]}[name]
        assert [r.lang for r in docs.where("doc_id = 5").collect()] == ["en"]
    (row,) = (r for r in corpus_pipeline.STAGES[4][1](spark, docs, "").collect() if r.doc_id == 1)
    assert row.n_tokens > 17_000


def test_workers_keep_nothing_after_a_stage(spark):
    import pyarrow as pa

    docs = spark.createDataFrame([(i, f"a text of its own, the number {i} of a few", "en", "a") for i in range(40)], "doc_id long, text string, lang string, source string").repartition(4)

    def kept(batches):
        for b in batches:
            n = len(ngram_join.WORDS) + langid.loaded.cache_info().currsize + pieces.codec.cache_info().currsize
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(b), pa.int64())], names=["n"])

    for k in (0, 2, 4):
        corpus_pipeline.STAGES[k][1](spark, docs, "").collect()
        assert {r.n for r in spark.range(0, 16, 1, 8).mapInArrow(kept, "n long").collect()} == {0}
