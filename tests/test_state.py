"""Keyed stream state: flushes, echoes, last conflicts, each with a restart from its checkpoint."""

from __future__ import annotations

import datetime as dt

import pytest

from deltaloom.streaming import state

START = dt.datetime(2024, 1, 1)


def at(seconds: float) -> dt.datetime:
    return START + dt.timedelta(seconds=seconds)


@pytest.fixture
def stream(spark, tmp_path):
    """Runs a transformation over what a batch of rows adds; each call is a restart from the same checkpoint."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    state.use_rocksdb(spark)
    folder, out, n = tmp_path / "in", tmp_path / "out", [0]

    def run(transformed, schema, rows, mode="append"):
        n[0] += 1
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        collected = []
        query = transformed(spark.readStream.schema(schema).parquet(str(folder))).writeStream.outputMode(mode).option("checkpointLocation", str(out)).trigger(availableNow=True)
        query.foreachBatch(lambda df, _: collected.extend(df.collect())).start().awaitTermination(120)
        return collected

    yield run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_edges_are_gathered_flushed_and_cleared(stream):
    schema = "file string, ts timestamp, side string, src string, type string, dst string"
    run = lambda rows: [(r.file, [tuple(x) for x in r.added], [tuple(x) for x in r.removed]) for r in stream(state.edge_updates, schema, rows)]
    assert run([("a.go", at(0), "added", "a", "CALLS", "b"), ("a.go", at(5), "removed", "a", "CALLS", "c"), ("b.go", at(30), "added", "x", "TESTS", "y"), (None, at(1), "added", "x", "y", "z")]) == []
    # The watermark is at 20 s after the first batch and passes 30 s with the next one.
    assert run([("b.go", at(45), "added", "x", "TESTS", "z")]) == [("a.go", [("a", "CALLS", "b")], [("a", "CALLS", "c")])]
    later = run([("a.go", at(100), "added", "a", "IMPORTS", "d")])
    assert later == [("b.go", [("x", "TESTS", "y"), ("x", "TESTS", "z")], [])]
    assert run([("c.go", at(200), "added", "p", "CALLS", "q")]) == [("a.go", [("a", "IMPORTS", "d")], [])]  # nothing of the first flush is left


def test_echoes_of_own_writes_are_held_back(stream):
    schema = "path string, ts timestamp, origin string, digest string"
    run = lambda rows: [(r.path, r.digest) for r in stream(state.edits, schema, rows)]
    first = run([("a", at(0), "sync", "d1"), ("a", at(0.5), "user", "d9"), ("a", at(20), "user", "d1"), ("b", at(1), "user", "e1")])
    assert first == [("b", "e1")]
    assert run([("a", at(30), "user", "d2")]) == [("a", "d2")]  # after a restart: other content is an edit and ends the hold
    assert run([("a", at(31), "user", "d1"), ("c", at(31), "sync", "f1")]) == [("a", "d1")]
    assert run([("c", at(95), "user", "f1")]) == [("c", "f1")]  # a minute later it is no echo any more


def test_the_last_ten_conflicts_are_kept(stream):
    schema = "agent string, ts timestamp, file string, message string"
    run = lambda rows: {r.agent: [c.file for c in r.conflicts] for r in stream(state.last_conflicts, schema, rows, "update")}
    assert run([("x", at(i), f"f{i:02}", "m") for i in range(8)] + [("y", at(1), "g", None)]) == {"x": [f"f{i:02}" for i in range(8)], "y": ["g"]}
    assert run([("x", at(i), f"f{i:02}", "m") for i in range(8, 14)]) == {"x": [f"f{i:02}" for i in range(4, 14)]}
