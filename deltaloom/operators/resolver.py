"""What names of nodes mean: full ids, slugs, refs, selectors and short ids, in this order.

Inputs have input and want (a kind, or null for any). A full id decides at once; a slug or ref of another kind than is wanted is passed
over; a selector is the last of its kind, or so many before. Short ids have at least eight hex digits, so the
first eight are a key: nodes and inputs meet by an equi-join on these, and only those of one key are compared digit by digit. Of the ids that begin with an
input, eleven are looked at and ten are told. Letters of ids may be of either case. Each result has status: found, wrong_kind, ambiguous or not_found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Names of kinds in selectors, digits of a full and of a short id, ids looked at and told.
KINDS = {"snap": "Snapshot", "snapshot": "Snapshot", "cs": "ChangeSet", "changeset": "ChangeSet", "ws": "Workspace", "workspace": "Workspace"}
FULL, SHORT, LOOKED, TOLD = 64, 8, 11, 10
SELECTOR = "^@(snap|cs|ws|snapshot|changeset|workspace):(last|prev)(~([0-9]{1,9}))?$"


def fits(kind: Column) -> Column:
    return F.col("want").isNull() | (F.col("want") == kind)


def by_prefix(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """asked (input, want, prefix: lower hex) with candidates: the first ids in order that begin with the prefix, LOOKED at most, and their kinds."""
    keyed = nodes.select("id", "kind", F.substring("id", 1, SHORT).alias("key"))
    near = asked.withColumn("key", F.substring("prefix", 1, SHORT)).join(keyed, "key").where(F.startswith("id", "prefix") & fits(F.col("kind")))
    first = near.withColumn("nth", F.row_number().over(W.partitionBy("input", "want").orderBy("id"))).where(F.col("nth") <= LOOKED)
    return first.groupBy("input", "want").agg(F.array_sort(F.collect_list(F.struct("id", "kind"))).alias("candidates"))


def resolved(inputs: DataFrame, nodes: DataFrame, slugs: DataFrame, refs: DataFrame, log: DataFrame) -> DataFrame:
    """input, want, status, via, id, kind, candidates for nodes (id, kind), slugs (slug, id), refs (name, id, kind) and log (kind, seq, id).

    Ids are in lower hex. Each input with its want comes once; null inputs are not found.
    """
    asked = inputs.select("input", "want").distinct()
    lower = F.lower("input")
    full = asked.where(lower.rlike(f"^[0-9a-f]{{{FULL}}}$")).withColumn("id", lower).join(nodes, "id", "left")
    full = full.select("input", "want", F.when(F.col("kind").isNull(), "not_found").when(fits(F.col("kind")), "found").otherwise("wrong_kind").alias("status"), F.lit("id").alias("via"), "id", "kind", F.lit(0).alias("rank"))
    rest = asked.join(full.select("input"), "input", "left_anti")
    hit = lambda df, via, rank: df.where(fits(F.col("kind"))).select("input", "want", F.lit("found").alias("status"), F.lit(via).alias("via"), "id", "kind", F.lit(rank).alias("rank"))
    slug = hit(rest.join(slugs.withColumnRenamed("slug", "input"), "input").join(nodes, "id"), "slug", 1)
    ref = hit(rest.join(refs.withColumnRenamed("name", "input"), "input"), "ref", 2)
    part = lambda i: F.regexp_extract("input", SELECTOR, i)
    kinds = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    back = F.when(part(2) == "prev", 1).otherwise(0) + F.coalesce(F.nullif(part(4), F.lit("")).cast("int"), F.lit(0)) + 1
    chosen = rest.where(F.col("input").rlike(SELECTOR)).select("input", "want", kinds[part(1)].alias("kind"), back.alias("nth"))
    latest = log.withColumn("nth", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("seq"), "id"))).select("kind", "nth", "id")
    selector = hit(chosen.join(latest, ["kind", "nth"]), "selector", 3)
    short = by_prefix(rest.where(lower.rlike(f"^[0-9a-f]{{{SHORT},}}$")).withColumn("prefix", lower), nodes)
    one = F.size("candidates") == 1
    short = short.select("input", "want", F.when(one, "found").otherwise("ambiguous").alias("status"), F.lit("short id").alias("via"), F.when(one, F.col("candidates")[0]["id"]).alias("id"), F.when(one, F.col("candidates")[0]["kind"]).alias("kind"), F.lit(4).alias("rank"), F.slice("candidates", 1, TOLD)["id"].alias("candidates"))
    none = F.array().cast("array<string>").alias("candidates")
    every = short
    for found in (full, slug, ref, selector):
        every = every.unionByName(found.select("*", none))
    best = every.groupBy(F.col("input").alias("input_"), F.col("want").alias("want_")).agg(F.min_by(F.struct("status", "via", "id", "kind", "candidates"), F.struct("rank", "id")).alias("x"))
    absent = F.struct(F.lit("not_found").alias("status"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("kind"), none)
    out = asked.join(best, F.col("input").eqNullSafe(F.col("input_")) & F.col("want").eqNullSafe(F.col("want_")), "left").select("input", "want", F.coalesce("x", absent).alias("x"))
    return out.select("input", "want", "x.*")
