"""Stored nodes and edges: lookups, scans, updates, deletions, packs, segments and overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def looked_up(wanted: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """The rows of wanted (key) with found: whether a node has that key."""
    there = nodes.select(key).distinct().withColumn("found", F.lit(True))
    return wanted.join(there, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def replaced(stored: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Insert-or-replace: of the rows with the same keys, the last by seq."""
    last = F.max_by(F.struct(*(c for c in stored.columns if c not in keys)), seq).alias("last")
    return stored.groupBy(*keys).agg(last).select(*keys, "last.*")


def updated(nodes: DataFrame, updates: DataFrame, key: str, payload: str) -> DataFrame:
    """nodes with the payload of their update (key unique in both), and updated. An update without a node is an error."""
    if updates.join(nodes.select(key), key, "left_anti").limit(1).count():
        raise ValueError("an update names a node that is not there")
    new = updates.select(key, F.col(payload).alias("new_payload"), F.lit(True).alias("updated"))
    rows = nodes.join(new, key, "left")
    out = [F.coalesce("new_payload", payload).alias(payload) if c == payload else F.col(c) for c in nodes.columns]
    return rows.select(*out, F.coalesce("updated", F.lit(False)).alias("updated"))


def deleted(edges: DataFrame, *by: DataFrame) -> DataFrame:
    """edges without those that agree with a row of any of by in all of its columns."""
    for rows in by:
        edges = edges.join(rows.distinct(), rows.columns, "left_anti")
    return edges


def packed(rows: DataFrame, pack: str, at: str, size: str, step: int = 1000) -> DataFrame:
    """rows with offset: the sizes of the rows of the same pack with a smaller at (a unique integer). Prefix sums run over
    ranges of at, so that a large pack is not summed by one task."""
    part = F.floor(F.col(at) / step).alias("part")
    rows = rows.withColumn("part", part)
    sums = rows.groupBy(pack, "part").agg(F.sum(size).alias("all"))
    starts = sums.select(pack, "part", (F.sum("all").over(W.partitionBy(pack).orderBy("part")) - F.col("all")).alias("start"))
    within = F.sum(size).over(W.partitionBy(pack, "part").orderBy(at)) - F.col(size)
    return rows.withColumn("within", within).join(starts, [pack, "part"]).withColumn("offset", F.col("start") + F.col("within")).drop("part", "start", "within")


def halving(refs: DataFrame, by: str, order: list[str], ref: str) -> DataFrame:
    """by, ref, settled: the middle of the refs of each group in order; of two or fewer the last, which is then the first bad one."""
    numbered = refs.withColumn("i", F.row_number().over(W.partitionBy(by).orderBy(*order)) - 1)
    numbered = numbered.withColumn("high", F.count("*").over(W.partitionBy(by)) - 1)
    settled = F.col("high") <= 1
    middle = F.when(settled, F.col("high")).otherwise(F.floor(F.col("high") / 2))
    return numbered.where(F.col("i") == middle).select(by, ref, settled.alias("settled"))


def latest(log: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The n rows of each group that come first in order; map tasks keep n of each already."""
    return log.withColumn("nth", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("nth") <= n)


def segments(log: DataFrame, by: str, order: list[str], is_mark: Column) -> DataFrame:
    """log with segment: how many marks of the group come up to and with each row."""
    return log.withColumn("segment", F.count_if(is_mark).over(W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def since(log: DataFrame, cursor: int, agent: int, limit: int) -> DataFrame:
    """The first rows behind the cursor that another agent wrote, and has_more."""
    rows = log.where((F.col("seq") > cursor) & (F.col("agent") != agent)).orderBy("seq").limit(limit + 1)  # one row more tells of others
    numbered = rows.withColumn("nth", F.row_number().over(W.orderBy("seq"))).withColumn("all", F.count("*").over(W.partitionBy()))
    return numbered.where(F.col("nth") <= limit).withColumn("has_more", F.col("all") > limit).drop("nth", "all")


def directories(path: str) -> Column:
    return F.split(F.when(F.col(path).contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(""), "/")


def shared_folder(a: Column, b: Column) -> Column:
    """The last of the directories that two paths begin with, null if there is none."""
    upto = F.sequence(F.lit(1), F.least(F.size(a), F.size(b)))
    shared = F.size(F.filter(upto, lambda i: F.slice(a, F.lit(1), i) == F.slice(b, F.lit(1), i)))
    return F.try_element_at(F.filter(F.slice(a, F.lit(1), shared), lambda x: (x != "") & (x != ".")), F.lit(-1))


def common_area(rows: DataFrame, by: str, path: str) -> DataFrame:
    """by, area: the last directory that all paths of a group share, or codebase. Only the least and the greatest matter."""
    parts = directories(path)
    ends = rows.groupBy(by).agg(F.min(parts).alias("a"), F.max(parts).alias("b"))
    return ends.select(by, F.coalesce(shared_folder(F.col("a"), F.col("b")), F.lit("codebase")).alias("area"))


def overlap(a: Column, b: Column) -> Column:
    """How many entries of b are in a, repeats in b counted."""
    return F.size(F.filter(b, lambda x: F.array_contains(a, x)))


def major(version: Column) -> Column:
    """The part of a version before the first dot, without range signs."""
    return F.split_part(F.regexp_replace(version, "^[\\^~>=<]+", ""), F.lit("."), F.lit(1))


def primary_areas(rows: DataFrame) -> DataFrame:
    """cluster, area for the signals (cluster, symbol, path): the commonest symbol, else the name of the one file without its ending, else the last directory that all files share."""
    symbols = rows.where("symbol IS NOT NULL").groupBy("cluster", "symbol").agg(F.count("*").alias("n"))
    named = symbols.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("minus"), "symbol"))["symbol"].alias("named"))  # ties: the first by name
    # What the least and the greatest path begin with, all in between begin with.
    files = rows.groupBy("cluster").agg(F.min("path").alias("one"), F.max("path").alias("other"))
    single = F.when(F.col("one") == F.col("other"), F.regexp_replace(F.regexp_extract("one", "[^/]*$", 0), r"\.[^.]*$", ""))
    whole = files.join(named, "cluster", "left")
    return whole.select("cluster", F.coalesce("named", single, shared_folder(directories("one"), directories("other")), F.lit("codebase")).alias("area"))


def accumulated(stored: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """The stored rows (key and totals, key unique) with the sums of more (the same columns, any number of rows) added; keys that were not stored begin at zero."""
    totals = [c for c in stored.columns if c != key]
    sums = more.groupBy(key).agg(*(F.sum(c).alias(c) for c in totals))
    return stored.unionByName(sums).groupBy(key).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in totals))


#: Characters that are tokens of their own; white space only parts tokens.
DELIMITERS = r"[(){}\[\];,.:+\-*/<>=!&|^~?@]|[^(){}\[\];,.:+\-*/<>=!&|^~?@ \t\n\r]+"


def token_similarities(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys (unique, not null), similarity of the texts a and b of each pair: the multiset Jaccard similarity of their tokens; 1 if neither has any, 0 if one has none.

    Tokens are counted by pair, in map tasks first; a long text is no more than its different tokens in any shuffle.
    """
    of = lambda c, first: pairs.select(*keys, F.explode(F.regexp_extract_all(F.col(c), F.lit(DELIMITERS), F.lit(0))).alias("token"), F.lit(first).alias("first"))
    counts = of(a, True).unionByName(of(b, False)).groupBy(*keys, "token").agg(F.count_if("first").alias("x"), F.count_if(~F.col("first")).alias("y"))
    sums = counts.groupBy(*keys).agg(F.sum(F.least("x", "y")).alias("common"), F.sum(F.col("x") + F.col("y")).alias("all"))
    value = F.col("common") / (F.col("all") - F.col("common"))
    return pairs.select(*keys).join(sums, keys, "left").select(*keys, F.coalesce(value, F.lit(1.0)).alias("similarity"))
