"""Events, tool logs and measurements: sessions, look-ahead, sparklines, digests, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaloom.operators.graph import SENT_ROWS
from deltaloom.sources.tables import settled


def used_later(log: DataFrame, ahead: int = 3) -> DataFrame:
    """session, seq, used: whether a call's symbols (an array) come up again in one of the next calls of its session."""
    by = W.partitionBy("session").orderBy("seq")
    used = F.lit(False)
    for k in range(1, ahead + 1):
        used = used | F.coalesce(F.arrays_overlap("symbols", F.lead("symbols", k).over(by)), F.lit(False))
    return log.select("session", "seq", used.alias("used"))


def debounced(events: DataFrame, quiet: str) -> DataFrame:
    """user, first_ts, last_ts, n, op: bursts of events of a user without a longer pause; the op of the last event."""
    burst = events.groupBy("user", F.session_window("ts", quiet).alias("w"))
    return burst.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.max_by("op", F.struct("ts", "id")).alias("op")).drop("w")


def sparkline(events: DataFrame, start: Column, buckets: int, seconds: int) -> DataFrame:
    """op, bucket, n with zeroes: counts in buckets of so many seconds from the start."""
    at = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / (seconds * 1_000_000)).cast("int")
    counts = events.select("op", at.alias("bucket")).where(F.col("bucket").between(0, buckets - 1)).groupBy("op", "bucket").agg(F.count("*").alias("n"))
    grid = events.select("op").distinct().select("op", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    return grid.join(counts, ["op", "bucket"], "left").select("op", "bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def counted_before(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n, before: how often each value is there, and how many rows of its keys have a smaller one.

    Prefix sums by ranges: values are counted, spread over tasks in order, summed up within a range and over the ranges; a key with most of the rows lies in many ranges.
    Null values are left out.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    spread = settled(counts.repartitionByRange(*keys, value).withColumn("range_", F.spark_partition_id()))
    sums = spread.groupBy(*keys, "range_").agg(F.sum("n").alias("all_"))
    start = F.sum("all_").over(W.partitionBy(*keys).orderBy("range_")) - F.col("all_")
    starts = sums.select(*(F.col(k).alias(f"{k}_") for k in keys), F.col("range_").alias("at_"), start.alias("start_"))  # a row for each range
    within = F.sum("n").over(W.partitionBy(*keys, "range_").orderBy(value)) - F.col("n")
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys), F.col("range_") == F.col("at_"))
    return spread.withColumn("within_", within).join(starts, same).select(*keys, value, "n", (F.col("start_") + F.col("within_")).alias("before"))


def percentiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """keys and a column for each wanted share: the value at that place of the sorted ones, between two by linear interpolation."""
    counts = counted_before(rows, keys, value)
    total = counts.groupBy(*(F.col(k).alias(f"{k}_") for k in keys)).agg(F.sum("n").alias("total_"))
    counts = counts.join(F.broadcast(total) if total.count() <= SENT_ROWS else total, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys)))
    at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col(value))).cast("double")
    out = []
    for name, share in wanted.items():
        place = (F.col("total_") - 1) * F.lit(share)
        out += [at(F.floor(place)).alias(f"{name}_lo"), at(F.ceil(place)).alias(f"{name}_hi"), F.max(place - F.floor(place)).alias(f"{name}_part")]
    ends = counts.groupBy(*keys).agg(*out)
    return ends.select(*keys, *((F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_part")).alias(n) for n in wanted))


def statistics(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, p90, mean, sample deviation, least and most of a value for each key (not null)."""
    v = F.col(value)
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg(v), 3).alias("mean"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 2).alias("stddev"), F.min(v).alias("least"), F.max(v).alias("most")
    )
    places = percentiles(rows, keys, value, {"median": 0.5, "p90": 0.9}).select(*keys, *(F.round(c, 3).alias(c) for c in ("median", "p90")))
    return sums.join(places, keys, "left").select(*keys, "n", "median", "p90", "mean", "stddev", "least", "most")


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, upper_median: the value at place n div 2 of the sorted ones."""
    counts = counted_before(rows, [key], value)
    total = counts.groupBy(key).agg(F.sum("n").alias("all"))
    middle = F.floor(F.col("all") / 2)
    return counts.join(total, key).where((F.col("before") <= middle) & (middle < F.col("before") + F.col("n"))).select(key, F.col(value).alias("upper_median"))


def transitions(events: DataFrame, valid: list[tuple[str, str]]) -> DataFrame:
    """before, after, n: moves between the states of each key's events (key, ts, id, state) that the list does not allow."""
    moves = events.withColumn("before", F.lag("state").over(W.partitionBy("key").orderBy("ts", "id"))).where("before IS NOT NULL AND before <> state")
    allowed = events.sparkSession.createDataFrame(valid, "before string, after string")  # a fixed, short table
    counts = moves.groupBy("before", F.col("state").alias("after")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(allowed), ["before", "after"], "left_anti")


def first_rule(text: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(kind, severity) of the first rule (pattern, kind, severity) that a text matches; null if none does."""
    kind = severity = F.lit(None).cast("string")
    for pattern, k, s in reversed(rules):
        hit = text.rlike(pattern)
        kind, severity = F.when(hit, F.lit(k)).otherwise(kind), F.when(hit, F.lit(s)).otherwise(severity)
    return kind, severity


def repo_verdicts(runs: DataFrame, failure: Column, passing: Column, selected: Column, least: float) -> DataFrame:
    """repo, baseline, selective (mean values), fallback_rate, missed, flaky, fallbacks, verdict for runs (repo, test, event_type, value, ts, event_id).

    A failure is flaky if the same test of the repository passes later; one that never does and has a value above least was missed. Verdicts: missed, then flaky, then fallback (any failure), then safe.
    """
    order = F.struct("ts", "event_id")
    passed = runs.where(passing).groupBy("repo", "test").agg(F.max(order).alias("last"))  # a later pass is there if the last one is later
    flagged = runs.withColumn("failed", failure).withColumn("at", order).join(passed, ["repo", "test"], "left")
    later = F.coalesce(F.col("last") > F.col("at"), F.lit(False))
    mean = lambda kind: F.round(F.avg(F.when(kind, F.col("value"))), 6)
    rows = flagged.groupBy("repo").agg(
        mean(passing).alias("baseline"), mean(selected).alias("selective"), F.round(F.count_if("failed") / F.count("*"), 6).alias("fallback_rate"),
        F.count_if(F.col("failed") & ~later & (F.col("value") > least)).alias("missed"), F.count_if(F.col("failed") & later).alias("flaky"), F.count_if("failed").alias("fallbacks"),
    )
    verdict = F.when(F.col("missed") > 0, "missed").when(F.col("flaky") > 0, "flaky").when(F.col("fallbacks") > 0, "fallback").otherwise("safe")
    return rows.withColumn("verdict", verdict)


def reductions(runs: DataFrame) -> DataFrame:
    """repo, baseline_ms, total_ms, adjusted_ms, fallback_rate, time_reduction, test_reduction for runs (repo, mode: baseline or selective, seconds, plan_ms, fallback, tests_total, tests_selected), and a row for all.

    Times are medians. Runs that fell back cost as much as the baseline, so the time of the others is blended with it by the rate of fallbacks. The row for all
    compares sums of times and tests, not means of the reductions.
    """
    selective = F.col("mode") == "selective"
    mode = lambda m, value, name: percentiles(runs.where(F.col("mode") == m), ["repo"], value, {name: 0.5})
    sums = runs.groupBy("repo").agg(
        F.avg(F.when(selective, F.col("fallback").cast("double"))).alias("fallback_rate"), F.sum(F.when(selective, F.col("tests_total"))).alias("tests_total"), F.sum(F.when(selective, F.col("tests_selected"))).alias("tests_selected"),
    )
    rows = sums.join(mode("baseline", "seconds", "base"), "repo", "left").join(mode("selective", "seconds", "own"), "repo", "left").join(mode("selective", "plan_ms", "plan"), "repo", "left")
    ms = lambda c: F.round(F.coalesce(c, F.lit(0.0))).cast("long")
    rate = F.coalesce("fallback_rate", F.lit(0.0))
    rows = rows.select("repo", ms(F.col("base") * 1000).alias("baseline_ms"), ms(F.coalesce("plan", F.lit(0.0)) + F.coalesce("own", F.lit(0.0)) * 1000).alias("total_ms"), rate.alias("fallback_rate"), "tests_total", "tests_selected")
    known = F.col("baseline_ms") > 0
    blend = F.round((1 - F.col("fallback_rate")) * F.col("total_ms") + F.col("fallback_rate") * F.col("baseline_ms")).cast("long")
    adjusted = F.when((F.col("fallback_rate") == 1) & known, F.col("baseline_ms")).when((F.col("fallback_rate") > 0) & known & (F.col("total_ms") > 0), blend).otherwise(F.col("total_ms"))
    rows = rows.withColumn("adjusted_ms", adjusted)
    less = lambda part, whole: F.coalesce(F.when((whole > 0) & (part >= 0), F.round((1 - part / whole) * 100, 1)), F.lit(0.0))
    timed = known & (F.col("adjusted_ms") > 0)
    each = rows.select("repo", "baseline_ms", "total_ms", "adjusted_ms", F.round("fallback_rate", 4).alias("fallback_rate"), F.when(timed, less(F.col("adjusted_ms"), F.col("baseline_ms"))).otherwise(0.0).alias("time_reduction"), less(F.col("tests_selected"), F.col("tests_total")).alias("test_reduction"))
    over = lambda c: F.sum(F.when(timed, F.col(c)))
    whole = rows.agg(over("baseline_ms").alias("baseline_ms"), over("total_ms").alias("total_ms"), over("adjusted_ms").alias("adjusted_ms"), F.sum("tests_total").alias("t"), F.sum("tests_selected").alias("s"))
    whole = whole.select(F.lit("all").alias("repo"), "baseline_ms", "total_ms", "adjusted_ms", F.lit(None).cast("double").alias("fallback_rate"), less(F.col("adjusted_ms"), F.col("baseline_ms")).alias("time_reduction"), less(F.col("s"), F.col("t")).alias("test_reduction"))
    return each.unionByName(whole)
