"""Even shards that keep equal texts together, by balanced label propagation.

Documents are linked when their texts are equal. Every document starts in the shard that its hash names. The linked
documents that share a text and a first shard move as one bundle; in each round a join of the bundles with the weights
of their group in every shard finds the neighbours' heaviest shard that has room, and a bundle moves there as far as
the shard's quota allows. Groups larger than a quarter of a quota, fewer than four for each shard, fill one shard after
another first. Documents without links stay
where they are and level the counts at the end: each shard keeps as many rows as its quota (counts differ by one at
most), rows without links leave first.

Slots come from prefix sums over buckets of hashed ids, so no shard is numbered by one task; only counts for each shard
reach the driver.

Defined results: a null text has size 8, crc 0 and no links; the empty text is a text as any other. Null and repeated
doc_ids are rows as any others. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Rows that one task numbers at once, about.
BUCKET_ROWS = 5_000


def by_shard(values: dict[int, float], of: Column, default: float = 0) -> Column:
    """A column with a value for each shard."""
    array = [values.get(k, default) for k in range(max(values, default=0) + 1)]
    return F.coalesce(F.get(F.array(*map(F.lit, array)), of), F.lit(default))


def fill(bundles: list[tuple[int, int, int]], room: dict[int, int]) -> list[tuple[int, int, int]]:
    """Shards for the bundles (gid, origin, n) of groups that are too large for chance: gid, origin, shard.

    Each group fills the shards where it is heaviest with its bundles from the lightest ones. There are fewer than four such groups
    for each shard, with a bundle for each shard.
    """
    out, groups = [], {}
    for gid, origin, n in bundles:
        groups.setdefault(gid, []).append((n, origin))
    for gid, own in sorted(groups.items(), key=lambda g: (-sum(n for n, _ in g[1]), g[0])):
        own.sort(key=lambda x: (-x[0], x[1]))
        at = {origin: origin for _, origin in own}
        first, last = 0, len(own) - 1
        while first < last:
            (n, light), heavy = own[last], own[first][1]
            if n <= room[heavy]:
                room[heavy] -= n
                room[light] += n
                at[light] = heavy
                last -= 1
            else:
                first += 1
        out += [(gid, origin, cur) for origin, cur in at.items()]
    return out


def propagate(rows: DataFrame, shards: int, quota: int, rounds: int) -> DataFrame:
    """gid, origin, cur: the shard of each bundle of linked rows after the last round."""
    spark, each = rows.sparkSession, W.partitionBy("gid")
    bundles = written(
        rows.where("gid is not null").groupBy("gid", "origin").agg(F.count("*").alias("n"))
        .withColumn("all", F.sum("n").over(each)).where("all > 1")  # at most one row of a group for each shard
    )
    large = F.col("all") > max(1, quota // 4)

    def loads(of: DataFrame, shard: str) -> dict[int, int]:
        return {r[0]: r[1] for r in of.groupBy(shard).agg(F.sum("n")).collect()}

    load = loads(bundles, "origin")
    placed = fill([tuple(r) for r in bundles.where(large).select("gid", "origin", "n").collect()], {k: quota - load.get(k, 0) for k in range(shards)})
    placed = spark.createDataFrame(placed, "gid long, origin int, cur int")
    state = written(bundles.join(F.broadcast(placed), ["gid", "origin"], "left").select("gid", "origin", "n", large.alias("large"), F.coalesce("cur", "origin").alias("cur")))
    for turn in range(rounds):
        load = loads(state, "cur")
        room = {k: max(0, quota - load.get(k, 0)) for k in range(shards)}
        pull = state.where("not large").groupBy("gid", "cur").agg(F.sum("n").alias("w"))
        pull = pull.withColumn("pull", F.struct("w", F.xxhash64("gid", "cur").alias("tie"), "cur"))
        to = pull.where(by_shard(room, F.col("cur")) > 0).groupBy("gid").agg(F.max("pull").alias("to"))
        wish = state.join(pull.select("gid", "cur", "pull"), ["gid", "cur"], "left").join(to, "gid", "left")
        wish = wish.withColumn("moves", F.coalesce((F.col("to") > F.col("pull")) & (F.col("n") <= by_shard(room, F.col("to.cur"))), F.lit(False)))
        wanted = {r.t: r.n for r in wish.where("moves").groupBy(F.col("to.cur").alias("t")).agg(F.sum("n").alias("n")).collect()}
        if not wanted:
            break
        share = {k: min(1.0, room[k] / n) for k, n in wanted.items()}
        chance = F.pmod(F.xxhash64("gid", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)  # the same for all of a group
        moved = F.col("moves") & (chance < by_shard(share, F.col("to.cur")))
        state = written(wish.select("gid", "origin", "n", "large", F.when(moved, F.col("to.cur")).otherwise(F.col("cur")).alias("cur")))
    return state.select("gid", "origin", "cur")


def balanced_shards(docs: DataFrame, shards: int = 24, rounds: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs."""
    text = F.coalesce("text", F.lit(""))
    crc = F.crc32(text.cast("binary"))
    rows = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), crc.alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("gid"),
        F.pmod(F.xxhash64("doc_id", crc), F.lit(shards)).cast("int").alias("origin"),
    ))
    total = rows.count()
    base, more = divmod(total, shards)
    placed = rows.join(propagate(rows, shards, base, rounds), ["gid", "origin"], "left")
    buckets = max(1, total // (shards * BUCKET_ROWS))
    placed = written(placed.select(
        "doc_id", "size", "text_crc32", F.coalesce("cur", "origin").alias("cur"),
        (F.pmod(F.xxhash64("text_crc32", "doc_id", F.lit(1)), F.lit(buckets)) + F.when(F.col("cur").isNull(), buckets).otherwise(0)).alias("bucket"),
    ))
    sizes = placed.groupBy("cur", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("cur", "bucket", (F.sum("n").over(W.partitionBy("cur").orderBy("bucket")) - F.col("n")).alias("before"))
    row = F.row_number().over(W.partitionBy("cur", "bucket").orderBy("doc_id", "text_crc32", "size"))
    ranked = placed.withColumn("row", row).join(before, ["cur", "bucket"]).withColumn("rank", F.col("before") + F.col("row") - 1)
    load = {k: 0 for k in range(shards)} | {r.cur: r.n for r in sizes.groupBy("cur").agg(F.sum("n").alias("n")).collect()}
    larger = sorted(load, key=lambda k: (-load[k], k))[:more]
    quota = {k: base + (k in larger) for k in range(shards)}
    first, seen, gaps, at = {}, 0, [], 0  # rows above their shard's quota, in order of shard and rank, fill the gaps of the others
    for k in range(shards):
        first[k], seen = seen, seen + max(0, load[k] - quota[k])
        if (gap := quota[k] - load[k]) > 0:
            gaps.append((at, at + gap, k))
            at += gap
    index = by_shard(first, F.col("cur")) + F.col("rank") - by_shard(quota, F.col("cur"))
    shard, slot = F.col("cur"), F.col("rank")
    over = F.col("rank") >= by_shard(quota, F.col("cur"))
    for start, end, k in gaps:
        here = over & (index >= start) & (index < end)
        shard, slot = F.when(here, F.lit(k)).otherwise(shard), F.when(here, index - start + load[k]).otherwise(slot)
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
