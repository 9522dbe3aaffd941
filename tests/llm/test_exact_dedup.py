from __future__ import annotations

import hashlib
import re

from deltaloom.llm import exact_dedup

ROWS = [(5, "a  b", "x"), (3, "a\tb", "y"), (9, " a b", "z"), (1, None, None), (2, "", "q"), (7, " \n ", "q"), (8, " ", "q"), (None, "a b", "n"), (3, "a b", "y"), (11, "w " * 50_000, "long"), (12, "w  " * 50_000, "long"), (13, "a b", "nbsp")]


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    out = []
    for i, t, *_ in rows:
        norm = re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
        ids = [x for x in groups[norm] if x is not None]
        out.append((i, min(ids), len(groups[norm]), i == min(ids), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def test_squeezed():
    for t in ("", " ", "\n\n", "a", " a", "a ", "\ta\x0b\x0cb\r\n", "a  b"):
        assert exact_dedup.squeezed(t.encode()).decode() == re.sub(r"[\x20\x09-\x0d]+", " ", t)


def test_groups_and_collisions(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, h string")
    for bits, capacity in ((63, 5_000), (3, 2), (1, 1)):
        got = [tuple(r) for r in exact_dedup.exact_groups(docs, bits, capacity).collect()]
        assert sorted(got, key=str) == brute(ROWS)


def test_distinct_rows_keep_columns(spark):
    docs = spark.createDataFrame(ROWS, "doc_id int, text string, h string")
    for bits in (63, 2):
        got = exact_dedup.distinct_rows(docs, bits, 2)
        assert got.dtypes == docs.dtypes
        assert sorted((r.doc_id, r.h) for r in got.collect()) == [(1, None), (3, "y"), (7, "q"), (9, "z"), (11, "long"), (13, "nbsp")]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(docs).count() == 0
    assert exact_dedup.distinct_rows(docs).count() == 0


def test_directory_splits_and_doubles():
    d = exact_dedup.Directory({0: 100, 1: 1, 5: 3, 7: 3}, 3, 5)
    assert d.depth == 3 and d.buckets[0] != d.buckets[1] and d.buckets[2] == d.buckets[3]
    assert len(set(d.buckets)) == 5 and d.buckets[4] == d.buckets[5] and d.buckets[6] == d.buckets[7]
