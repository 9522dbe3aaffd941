"""Change signals put together in clusters: by module and linked files, single ones joined, large loose ones split by affinity.

Signals have change, id (unique in a change), module (null: General), path, category, confidence, symbols and tags (arrays). Within a change and module, files that
import one another or stand in one folder are linked; each component is a cluster, named by its first path. A cluster of one signal goes to the
first cluster of its module with more; where a module has none, all its single ones make one. A cluster of more than
MOST signals with a cohesion below COHESIVE is split: in the order of ids, a signal goes to the earliest seed with an affinity above NEAR, and is
a new seed if there is none.

The split depends on the order, yet runs in rounds over all clusters at once. Equal signals always stay together, so one
of each stands for them. Two signals reach NEAR only if they share a path, a symbol, or a category and a tag; a round
decides every signal that no earlier undecided signal shares any of these with, by the best seed it has met so far.
Joins are between undecided signals and the new seeds of a round only, so no cluster is ever compared with itself as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.functions.paths import folder
from deltaloom.operators import graph
from deltaloom.operators.signals import COHESIVE, clusters, cohesion_of
from deltaloom.sources.tables import settled

#: Signals that a cluster may have before it is split, and the affinity that keeps two together.
MOST, NEAR = 8, 0.3
KEY = ("change", "module", "root")


def linked(signals: DataFrame, imports: DataFrame) -> DataFrame:
    """change, module, path, root: the component of each file, by its first path."""
    files = settled(signals.select("change", "module", "path").distinct())
    node = lambda path: F.to_json(F.array(F.col("change").cast("string"), F.col("module"), path))
    dirs = files.groupBy("change", "module", folder(F.col("path")).alias("dir")).agg(F.min("path").alias("first"))
    near = files.withColumn("dir", folder(F.col("path"))).join(dirs, ["change", "module", "dir"]).select(node(F.col("path")).alias("a"), node(F.col("first")).alias("b"))
    other = files.select("change", "module", F.col("path").alias("file"))
    known = imports.select(F.col("importer").alias("path"), "file").distinct()
    used = files.join(known, "path").join(other, ["change", "module", "file"]).select(node(F.col("path")).alias("a"), node(F.col("file")).alias("b"))
    roots = graph.components(near.unionByName(used))
    return files.withColumn("node", node(F.col("path"))).join(roots, "node").select("change", "module", "path", F.element_at(F.from_json("root", "array<string>"), 3).alias("root"))


def together(signals: DataFrame, roots: DataFrame) -> DataFrame:
    """The signals with root: their cluster after single ones are joined."""
    rows = signals.join(roots, ["change", "module", "path"])
    sizes = settled(rows.groupBy(*KEY).agg(F.count("*").alias("n")))
    host = sizes.groupBy("change", "module").agg(F.min(F.struct((F.col("n") < 2).alias("single"), "root"))["root"].alias("host"))
    moved = sizes.join(host, ["change", "module"]).select(*KEY, F.when(F.col("n") < 2, F.col("host")).otherwise(F.col("root")).alias("cluster"))
    return rows.join(moved, list(KEY)).drop("root").withColumnRenamed("cluster", "root")


def affinity(a: str, b: str) -> Column:
    """How near two signals are, in the order of the sum: path, symbols, category, tags."""
    of = lambda x, c: F.col(f"{x}.{c}")
    share = lambda c: F.size(F.array_intersect(of(a, c), of(b, c))) / F.greatest(F.size(of(a, c)), F.size(of(b, c)), F.lit(1))
    same = lambda c, value: F.when(of(a, c) == of(b, c), value).otherwise(0.0)
    return ((same("path", 0.4) + F.lit(0.3) * share("symbols")) + same("category", 0.2)) + F.lit(0.1) * share("tags")


def seeded(rows: DataFrame) -> DataFrame:
    """cluster, pos, seed for profiles (cluster, pos, x: path, category, symbols, tags): the seed that a pass in the order of pos puts each one to."""
    tagged = F.transform("x.tags", lambda t: F.to_json(F.array(F.col("x.category"), t)))
    keys = F.array_distinct(F.concat(F.array(F.concat(F.lit("p"), "x.path")), F.transform("x.symbols", lambda s: F.concat(F.lit("s"), s)), F.transform(tagged, lambda t: F.concat(F.lit("t"), t))))
    left = settled(rows.select("cluster", "pos", "x", keys.alias("keys"), F.lit(None).cast("long").alias("seed")))
    done = []
    while not left.isEmpty():
        keyed = left.select("cluster", "pos", F.explode("keys").alias("key"))
        first = keyed.groupBy("cluster", "key").agg(F.min("pos").alias("first"))
        low = keyed.join(first, ["cluster", "key"]).groupBy("cluster", "pos").agg(F.min("first").alias("low"))
        state = settled(left.join(low, ["cluster", "pos"]))
        own = (F.col("low") == F.col("pos")) & F.col("seed").isNull()
        decided = (F.col("low") == F.col("pos")) | F.coalesce(F.col("seed") < F.col("low"), F.lit(False))
        done.append(state.where(decided).select("cluster", "pos", F.coalesce("seed", "pos").alias("seed")))
        seeds = state.where(own).select("cluster", F.col("pos").alias("new"), F.struct("x.*").alias("y"), F.explode("keys").alias("key"))
        rest = state.where(~decided)
        met = rest.select("cluster", "pos", "x", F.explode("keys").alias("key")).join(seeds, ["cluster", "key"]).where((F.col("new") < F.col("pos")) & (affinity("x", "y") > NEAR))
        best = met.groupBy("cluster", "pos").agg(F.min("new").alias("new"))
        left = settled(rest.join(best, ["cluster", "pos"], "left").select("cluster", "pos", "x", "keys", F.least("seed", "new").alias("seed")))
    return reduce(DataFrame.unionByName, done) if done else left.select("cluster", "pos", "seed")


def clustered(signals: DataFrame, imports: DataFrame) -> DataFrame:
    """change, id, module, cluster: the cluster's first path, with # and the id of its seed if it was split. imports: importer, file."""
    rows = signals.withColumn("module", F.coalesce("module", F.lit("General"))).select("change", "id", "module", "path", "category", "confidence", *(F.array_sort(F.array_distinct(F.coalesce(c, F.array()))).alias(c) for c in ("symbols", "tags")))
    rows = settled(together(rows, linked(rows, imports)).withColumn("cluster", F.to_json(F.array(F.col("change").cast("string"), "module", "root"))))
    loose = clusters(rows).where((F.col("n") > MOST) & (cohesion_of() < COHESIVE)).select("cluster")
    profile = F.struct("path", "category", "symbols", "tags").alias("x")
    open_ = settled(rows.join(loose, "cluster", "left_semi").select("cluster", "id", profile))
    seeds = seeded(open_.groupBy("cluster", "x").agg(F.min("id").alias("pos")))
    placed = open_.withColumn("pos", F.min("id").over(graph.W.partitionBy("cluster", "x"))).join(seeds, ["cluster", "pos"]).select("cluster", "id", "seed")
    name = F.concat("root", F.coalesce(F.concat(F.lit("#"), F.col("seed").cast("string")), F.lit("")))
    return rows.join(placed, ["cluster", "id"], "left").select("change", "id", "module", name.alias("cluster"))
