"""Questions over the edges of a code graph (src, type, dst): src depends on dst."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaloom.functions.paths import is_test, matches_any
from deltaloom.sources.tables import settled

#: Rows of a frontier that go to each executor at once; a larger one is joined by a shuffle.
SENT_ROWS = 500_000


def sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def dependants(edges: DataFrame, kinds: tuple[str, ...] = ("IMPORTS", "CALLS")) -> DataFrame:
    """path, n: how many different files depend on each."""
    return edges.where(F.col("type").isin(*kinds)).groupBy(F.col("dst").alias("path")).agg(F.countDistinct("src").alias("n_dependents"))


def dependencies(edges: DataFrame, kinds: tuple[str, ...] = ("IMPORTS", "CALLS")) -> DataFrame:
    return edges.where(F.col("type").isin(*kinds)).groupBy(F.col("src").alias("path")).agg(F.countDistinct("dst").alias("n_dependencies"))


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 3, kinds: tuple[str, ...] = ("IMPORTS", "CALLS")) -> DataFrame:
    """path, hop, is_test: what a change of the seeds (path) can reach against the edges, by the first hop that does; seeds are not listed."""
    back = settled(edges.where(F.col("type").isin(*kinds)).select(F.col("src").alias("next"), F.col("dst").alias("path")))
    seen = seeds.select("path", F.lit(0).alias("hop")).distinct()
    frontier = seen.select("path")
    for hop in range(1, depth + 1):
        near, few = counted(frontier)
        if hop > 1 and not few:
            break
        found = back.join(near, "path").select(F.col("next").alias("path")).distinct()
        frontier = settled(found.join(seen.select("path"), "path", "left_anti"))
        seen = seen.unionByName(frontier.select("path", F.lit(hop).alias("hop")))
    return seen.where("hop > 0").select("path", "hop", is_test(F.col("path")).alias("is_test"))


def counted(frontier: DataFrame) -> tuple[DataFrame, int]:
    """A frontier, marked for broadcast if it is small, and its size (no more than just above the bound)."""
    n = frontier.limit(SENT_ROWS + 1).count()
    return (F.broadcast(frontier) if n <= SENT_ROWS else frontier), n


def reached(edges: DataFrame, roots: DataFrame, most: int = 200) -> DataFrame:
    """path: all that the roots (path) lead to along the edges of all types, roots included. Each round writes what it adds; nothing is written twice."""
    out = settled(edges.select(F.col("src").alias("path"), "dst").distinct())
    seen = frontier = settled(roots.select("path").distinct())
    for _ in range(most):
        near, few = counted(frontier)
        if not few:
            return seen
        found = out.join(near, "path").select(F.col("dst").alias("path")).distinct()
        frontier = settled(found.join(seen, "path", "left_anti"))
        seen = seen.unionByName(frontier)
    raise RuntimeError("the graph is deeper than allowed")


def reached_from_each(edges: DataFrame, starts: DataFrame, most: int = 1000) -> DataFrame:
    """start, path: all that each start (path) leads to along the edges (src, dst), itself only if a cycle comes back to it.

    Rounds move a frontier of (start, path) pairs, each pair once. A node's successors are joined by a shuffle that adaptive execution splits where
    one node is reached from very many starts.
    """
    out = settled(edges.where("src <> dst").select(F.col("src").alias("path"), "dst").distinct())
    frontier = settled(starts.select(F.col("path").alias("start"), "path").distinct().join(out, "path").select("start", F.col("dst").alias("path")).distinct())
    seen = frontier
    for _ in range(most):
        if frontier.isEmpty():
            return seen
        found = frontier.join(out, "path").select("start", F.col("dst").alias("path")).distinct()
        frontier = settled(found.join(seen, ["start", "path"], "left_anti"))
        seen = seen.unionByName(frontier)
    raise RuntimeError("the graph is deeper than allowed")


def test_edges(edges: DataFrame) -> DataFrame:
    """test, path: a TESTS edge from each test file to every other file that it imports, straight or through others; paths lead through tests but do not end there."""
    nodes = edges.select(F.col("src").alias("path")).distinct()
    found = reached_from_each(edges, nodes.where(is_test(F.col("path"))))
    return found.where(~is_test(F.col("path"))).select(F.col("start").alias("test"), "path")


def unreachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes (path, kind) that no root reaches."""
    return nodes.join(reached(edges, roots), "path", "left_anti")


def related(edges: DataFrame, kinds: tuple[str, ...] = ("IMPORTS", "CALLS", "TESTS")) -> DataFrame:
    """path, other: neighbours in either direction, each once."""
    some = edges.where(F.col("type").isin(*kinds))
    return some.select(F.col("src").alias("path"), F.col("dst").alias("other")).unionByName(some.select(F.col("dst").alias("path"), F.col("src").alias("other"))).distinct()


def context(edges: DataFrame, most: int = 15) -> DataFrame:
    """path, side, total, shown: the first names of a file's dependents and dependencies, and how many there are."""
    some = settled(edges.where(F.col("type").isin("IMPORTS", "CALLS")).select("src", "dst").distinct())
    sides = some.select(F.col("dst").alias("path"), F.lit("dependents").alias("side"), F.col("src").alias("name")).unionByName(
        some.select(F.col("src").alias("path"), F.lit("dependencies").alias("side"), F.col("dst").alias("name"))
    )
    sides = sides.distinct()
    total = sides.groupBy("path", "side").agg(F.count("*").alias("total"))
    first = sides.withColumn("nth", F.row_number().over(W.partitionBy("path", "side").orderBy("name"))).where(F.col("nth") <= most)  # a limit for each group, applied before the shuffle too
    shown = first.groupBy("path", "side").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("shown"))
    return total.join(shown, ["path", "side"])


def blast_radius(edges: DataFrame, changed: DataFrame, protected: list[str], auto: int, block: int) -> DataFrame:
    """change, radius, verdict for changed (change, path): protected paths come first, then block (at least), then auto (at most)."""
    back = edges.where(F.col("type").isin("IMPORTS", "CALLS")).select("src", F.col("dst").alias("path"))
    callers = changed.join(back, "path").select("change", F.col("src").alias("path")).distinct().join(changed, ["change", "path"], "left_anti")
    radius = callers.groupBy("change").agg(F.count("*").alias("radius"))
    guard = changed.groupBy("change").agg(F.bool_or(matches_any(F.col("path"), protected)).alias("guarded"))
    n = F.coalesce("radius", F.lit(0).cast("long"))
    verdict = F.when(F.col("guarded"), "block").when(n >= block, "block").when(n <= auto, "auto").otherwise("review")
    return guard.join(radius, "change", "left").select("change", n.alias("radius"), "guarded", verdict.alias("verdict"))


def affected_tests(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """change, test for changed (change, path): tests of a changed file, and test-named files that import or call one."""
    hits = edges.withColumnRenamed("dst", "path").join(changed, "path")
    return hits.where((F.col("type") == "TESTS") | is_test(F.col("src"))).select("change", F.col("src").alias("test")).distinct()


#: Nodes that one task contracts at once.
FOREST = 300_000


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (u, v) of a task as pairs of each node and the smallest node that it reaches among them."""
    above: dict[str, str] = {}

    def top(x: str) -> str:
        while (y := above[x]) != x:
            above[x] = x = above[y]
        return x

    def out() -> pa.RecordBatch:
        stars = [(x, r) for x in above if (r := top(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in stars], pa.string()), pa.array([r for _, r in stars], pa.string())], names=["u", "v"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            above.setdefault(u, u)
            above.setdefault(v, v)
            x, y = top(u), top(v)
            if x != y:
                above[max(x, y)] = min(x, y)
        if len(above) > FOREST:
            yield out()
            above.clear()
    if above:
        yield out()


def components(pairs: DataFrame, most: int = 60) -> DataFrame:
    """node, root of an undirected graph of names (a, b): the smallest node of each one's component.

    Tasks first contract their own pairs to stars. Then rounds hang every node below its smallest neighbour and link its other neighbours to that one,
    until each node has one parent that has none itself. A parent is never the key of a shuffle with all of its children: only parents that are children, too, move them.
    """
    given = pairs.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").cast("string").alias("u"), F.least("a", "b").cast("string").alias("v"))
    state = settled(given.where("u <> v").mapInArrow(forest, "u string, v string").distinct())
    for _ in range(most):
        low = state.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        inner = settled(low.join(state.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select(F.col("u").alias("v"), "m"))
        near, few = counted(inner)
        if not few and low.where("n > 1").isEmpty():
            break
        lifted = state.join(near, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        low = lifted.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        split = lifted.join(low.where("n > 1"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = settled(low.select("u", F.col("m").alias("v")).unionByName(split).distinct())
    else:
        raise RuntimeError("the components have not settled")
    rest = given.select(F.col("u").alias("node")).unionByName(given.select(F.col("v").alias("node"))).distinct()
    return rest.join(state.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
