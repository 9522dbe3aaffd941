"""Invariants and hand-made cases of the operators."""

from __future__ import annotations

import datetime as dt

import pytest

from deltaloom.functions.paths import glob_pattern
from deltaloom.operators import activity, graph, history
from deltaloom.streaming import live


def test_impact_lists_first_hops_and_bounds_the_depth(spark):
    edges = spark.createDataFrame([("b", "IMPORTS", "a"), ("c", "CALLS", "b"), ("d", "IMPORTS", "c"), ("e", "IMPORTS", "d"), ("a", "IMPORTS", "c"), ("t", "TESTS", "a")], "src string, type string, dst string")
    seeds = spark.createDataFrame([("a",)], "path string")
    assert {(r.path, r.hop) for r in graph.impact(edges, seeds).collect()} == {("b", 1), ("c", 2), ("d", 3)}
    assert graph.impact(edges.limit(0), seeds).collect() == []


def test_unreachable_nodes_and_components(spark):
    edges = spark.createDataFrame([("a", "X", "b"), ("b", "Y", "c"), ("c", "X", "a"), ("y", "X", "z")], "src string, type string, dst string")
    nodes = spark.createDataFrame([(x, "File") for x in "abcyzq"], "path string, kind string")
    roots = spark.createDataFrame([("b",)], "path string")
    assert {r.path for r in graph.unreachable(nodes, edges, roots).collect()} == {"y", "z", "q"}
    pairs = spark.createDataFrame([(str(i), str(i + 1)) for i in range(10, 60)] + [("x", "y")], "a string, b string")
    got = {r.node: r.root for r in graph.components(pairs).collect()}
    assert got == {str(i): "10" for i in range(10, 61)} | {"x": "x", "y": "x"}


def test_status_of_a_snapshot_with_itself_is_same_and_mirrors(spark):
    a = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", "3")], "path string, digest string")
    b = spark.createDataFrame([("q", "2"), ("r", "4"), ("s", "5")], "path string, digest string")
    assert {r.status for r in history.status(a, a).collect()} == {"same"}
    assert {(r.path, r.status) for r in history.status(a, b).collect()} == {("p", "deleted"), ("q", "same"), ("r", "modified"), ("s", "added")}
    assert {(r.path, r.side) for r in history.delta(a, b, ["path"]).collect()} == {("p", "removed"), ("s", "added")}


@pytest.mark.parametrize(("base", "left", "right", "want"), [("1", "1", "2", ("right", None)), ("1", "2", "1", ("left", None)), ("1", "2", "2", ("same", None)), ("1", "2", "3", ("conflict", "BODY_DIVERGED")), (None, "2", "3", ("conflict", "CONCURRENT_CREATE")), ("1", None, "3", ("conflict", "DELETE_vs_MODIFY")), ("1", "3", None, ("conflict", "MODIFY_vs_DELETE")), ("1", None, None, ("same", None))])
def test_merge_table(spark, base, left, right, want):
    side = lambda x: spark.createDataFrame([("f", x)] if x else [], "path string, digest string")
    row = history.merged(side(base), side(left), side(right), ["path"]).first()
    assert (row.decision, row.conflict) == want


def test_changed_lines(spark):
    rows = [("p", "a\nb\nc", "a\nx\nc"), ("q", "a", "a\nb"), ("r", "a\na", "a\na\na"), ("s", "same", "same"), ("t", "", "x")]
    base = spark.createDataFrame([(p, x) for p, x, _ in rows], "path string, content string")
    head = spark.createDataFrame([(p, x) for p, _, x in rows], "path string, content string")
    got = {r.path: (r.prefix, r.old_end, r.new_end) for r in history.changed_lines(base, head).collect()}
    assert got == {"p": (1, 2, 2), "q": (1, 1, 2), "r": (2, 2, 3), "t": (0, 1, 1)}


def test_last_writer_owns_lines_and_runs_join(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("f", 1, 10, "ai", "x", t, 1), ("f", 4, 6, "human", "", t + dt.timedelta(1), 2), ("f", 11, 12, "ai", "x", t, 3)]
    ranges = spark.createDataFrame(rows, "file string, start_line long, end_line long, author_type string, agent string, ts timestamp, seq long")
    got = {(r.start_line, r.end_line, r.author_type) for r in history.consolidated(ranges).collect()}
    assert got == {(1, 3, "ai"), (4, 6, "human"), (7, 12, "ai")}


def test_globs():
    import re

    assert re.match(glob_pattern("src/**/*.ts"), "src/a/b/c.ts") and re.match(glob_pattern("src/**/*.ts"), "src/c.ts")
    assert not re.match(glob_pattern("src/*.ts"), "src/a/c.ts") and not re.match(glob_pattern("a.b"), "axb")


def test_streams_group_bursts_and_drop_repeats(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "u", "w", t), (1, "u", "w", t), (2, "u", "w", t + dt.timedelta(milliseconds=60)), (3, "u", "w", t + dt.timedelta(hours=2)), (4, "u", "w", t + dt.timedelta(hours=5))]
    spark.createDataFrame(rows, "id long, user string, op string, ts timestamp").write.parquet(str(tmp_path / "in"))
    for name, make in (("once", lambda s: live.once(s, ["id"])), ("bursts", live.bursts), ("recent", live.recent)):
        stream = spark.readStream.schema("id long, user string, op string, ts timestamp").parquet(str(tmp_path / "in"))
        run = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination(120)
    assert {r.id for r in spark.table("once").collect()} == {1, 2, 3, 4}
    assert 3 in {r.n for r in spark.table("bursts").collect()} and spark.table("recent").count() > 0


def test_confidence_boosts_and_penalties(spark):
    from deltaloom.operators import signals

    rows = [("one", "FUNCTION_RENAMED", 0.9, "api", "a.go")] + [("many", c, 1.0, "x", f"{i}.go") for i, c in enumerate(["IMPORT_ADDED"] * 7)]
    rows += [("docs", "CONSTANT_UPDATED", 1.0, "x", "readme.md"), ("auth", "FUNCTION_BODY_CHANGED", 1.0, "security", "b.go"), ("none", "OTHER", 1.0, "x", "c.go")]
    view = spark.createDataFrame(rows, "cluster string, category string, confidence double, tag string, path string")
    got = {r.cluster: r for r in signals.confidence(view).collect()}
    assert (got["one"].template, got["one"].confidence) == ("rename_function", round(0.95 * 0.9 * 1.15, 5))
    cohesion = 0.3 + 0.3 / 7 + 0.2 + 0.2
    assert (got["many"].template, got["many"].confidence) == ("update_imports", round(0.7 * cohesion * 0.95 * 0.92 * 0.92, 5))
    assert got["auth"].template == "update_auth_flow" and got["none"].template == "generic_update"
    kinds = {r.cluster: r.kind for r in signals.cluster_types(view).collect()}
    assert kinds == {"one": "bugfix", "many": "feature", "docs": "docs", "auth": "bugfix", "none": "mixed"}


def test_updates_need_their_nodes(spark):
    from deltaloom.operators import records

    nodes = spark.createDataFrame([(1, "a"), (2, "b")], "id int, payload string")
    new = spark.createDataFrame([(2, "c")], "id int, payload string")
    assert sorted(map(tuple, records.updated(nodes, new, "id", "payload").collect())) == [(1, "a", False), (2, "c", True)]
    with pytest.raises(ValueError, match="not there"):
        records.updated(nodes, new.selectExpr("id + 7 AS id", "payload"), "id", "payload")


def test_first_rule_that_matches_counts(spark):
    texts = spark.createDataFrame([("a b",), ("b",), ("c",), (None,)], "text string")
    rules = [("a", "first", "high"), ("b", "second", "low")]
    got = {r.text: (r.kind, r.severity) for r in texts.select("text", *(c.alias(n) for c, n in zip(activity.first_rule(texts.text, rules), ("kind", "severity"), strict=True))).collect()}
    assert got == {"a b": ("first", "high"), "b": ("second", "low"), "c": (None, None), None: (None, None)}
    assert texts.select(activity.first_rule(texts.text, [])[0].alias("kind")).where("kind IS NOT NULL").isEmpty()
