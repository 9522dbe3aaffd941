"""Snapshots, merges, refs and authorship: keyed diffs, latest-wins rows, line ownership."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaloom.sources.tables import settled


def latest(rows: DataFrame, keys: list[str], order: list[str], nth: int = 1) -> DataFrame:
    """The nth latest row of each key by the order columns."""
    by = W.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("nth_", F.row_number().over(by)).where(F.col("nth_") == nth).drop("nth_")


def deduplicated(edges: DataFrame) -> DataFrame:
    """src, type, dst, created_at, at, copies: one row of each edge, with the newest time and the context that goes with it."""
    newest = F.max(F.struct("created_at", "at"))
    return edges.groupBy("src", "type", "dst").agg(newest.alias("x"), F.count("*").alias("copies")).select("src", "type", "dst", "x.created_at", "x.at", "copies")


def delta(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The keys with side: added (new only) or removed (old only)."""
    old, new = old.select(*keys).distinct(), new.select(*keys).distinct()
    return new.join(old, keys, "left_anti").withColumn("side", F.lit("added")).unionByName(old.join(new, keys, "left_anti").withColumn("side", F.lit("removed")))


def status(base: DataFrame, head: DataFrame) -> DataFrame:
    """path, status of two snapshots (path, digest)."""
    both = base.select("path", F.col("digest").alias("old")).join(head.select("path", F.col("digest").alias("new")), "path", "full")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified").otherwise("same")
    return both.select("path", kind.alias("status"))


def merged(base: DataFrame, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, decision, conflict of a three-way merge of (keys, digest)."""
    side = lambda df, name: df.select(*keys, F.col("digest").alias(name))
    rows = side(base, "o").join(side(left, "l"), keys, "full").join(side(right, "r"), keys, "full")
    o, le, r = F.col("o"), F.col("l"), F.col("r")
    same = lambda a, b: a.eqNullSafe(b)
    decision = F.when(same(le, r), "same").when(same(le, o), "right").when(same(r, o), "left").otherwise("conflict")
    conflict = F.when(o.isNull(), "CONCURRENT_CREATE").when(le.isNull(), "DELETE_vs_MODIFY").when(r.isNull(), "MODIFY_vs_DELETE").otherwise("BODY_DIVERGED")
    return rows.select(*keys, decision.alias("decision"), F.when(decision == "conflict", conflict).alias("conflict"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    n = F.least(F.size(a), F.size(b))
    return F.coalesce(F.nullif(F.array_position(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.eqNullSafe(y)), False), F.lit(0)) - 1, n.cast("long"))


def changed_lines(base: DataFrame, head: DataFrame) -> DataFrame:
    """path, prefix, old_end, new_end of files in both snapshots (path, content) that differ: the changed lines are (prefix, end]."""
    both = base.select("path", F.split("content", "\n").alias("a")).join(head.select("path", F.split("content", "\n").alias("b")), "path").where("a <> b")
    both = both.withColumn("prefix", common_prefix(F.col("a"), F.col("b")))
    tail = lambda c: F.reverse(F.slice(c, (F.col("prefix") + 1).cast("int"), F.size(c)))
    both = both.withColumn("suffix", common_prefix(tail("a"), tail("b")))
    return both.select("path", "prefix", (F.size("a") - F.col("suffix")).alias("old_end"), (F.size("b") - F.col("suffix")).alias("new_end"))


def unit_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """path, added, removed, modified: units (path, unit, body) of two snapshots."""
    both = base.select("path", "unit", F.col("body").alias("old")).join(head.select("path", "unit", F.col("body").alias("new")), ["path", "unit"], "full")
    return both.groupBy("path").agg(
        F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("new").isNull()).alias("removed"), F.count_if(F.col("old") != F.col("new")).alias("modified")
    )


def symbol_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, name, action, change of the symbols (path, name, kind, signature, value) that are added, removed or modified; names are unique within a path.

    A changed signature is API_SURFACE_CHANGED; with the same one, a changed value of a variable or constant is CONSTANT_UPDATED. Other symbols are as they were.
    """
    side = lambda df, c: df.select("path", "name", F.struct("kind", "signature", "value").alias(c))
    rows = side(before, "b").join(side(after, "a"), ["path", "name"], "full")
    b, a = F.col("b"), F.col("a")
    valued = a["kind"].isin("variable", "const") & ~a["value"].eqNullSafe(b["value"])
    change = F.when(a.isNull() | b.isNull(), F.lit(None)).when(~a["signature"].eqNullSafe(b["signature"]), "API_SURFACE_CHANGED").when(valued, "CONSTANT_UPDATED")
    rows = rows.select("path", "name", F.when(b.isNull(), "added").when(a.isNull(), "removed").when(change.isNotNull(), "modified").alias("action"), change.alias("change"))
    return rows.where("action IS NOT NULL")


#: Operators whose change is a change of a condition.
OPERATORS = r"===|!==|==|!=|<=|>=|&&|\|\||<|>"


def near_pairs(before: DataFrame, after: DataFrame, lines: int = 2, columns: int | None = None) -> DataFrame:
    """file, type, before_id, after_id, old, new: nodes (file, type, id, line, col, text) of the same file and type at most so many lines (and columns) apart with different texts.

    Joined on stretches of lines, so that only neighbours meet. Every such pair is a result of its own.
    """
    width = lines + 1
    own = before.select("file", "type", F.col("id").alias("before_id"), F.col("line").alias("x"), F.col("col").alias("p"), F.col("text").alias("old"), F.explode(F.array(*(F.floor(F.col("line") / width) + k for k in (-1, 0, 1)))).alias("stretch"))
    new = after.select("file", "type", F.col("id").alias("after_id"), F.col("line").alias("y"), F.col("col").alias("q"), F.col("text").alias("new"), F.floor(F.col("line") / width).alias("stretch"))
    near = own.join(new, ["file", "type", "stretch"]).where((F.abs(F.col("x") - F.col("y")) <= lines) & (F.col("old") != F.col("new")))
    near = near if columns is None else near.where(F.abs(F.col("p") - F.col("q")) <= columns)
    return near.select("file", "type", "before_id", "after_id", "old", "new")


def condition_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """The near pairs of conditions whose operators or numbers differ."""
    parts = lambda c, pattern: F.regexp_extract_all(F.col(c), F.lit(pattern), F.lit(0))
    differ = lambda pattern: parts("old", pattern) != parts("new", pattern)
    return near_pairs(before, after).where(differ(OPERATORS) | differ(r"[0-9]+(?:\.[0-9]+)?"))


def merge_check(changes: DataFrame, links: DataFrame) -> DataFrame:
    """agent, own, shared, related for changes (agent, file): files of an agent, those that others changed as well, and files one link (a, b, either way) away that others changed and it did not."""
    mine = settled(changes.where("agent IS NOT NULL AND file IS NOT NULL").select("agent", "file").distinct())
    many = mine.groupBy("file").agg(F.count("*").alias("agents"))
    own = mine.join(many, "file").groupBy("agent").agg(F.count("*").alias("own"), F.count_if(F.col("agents") > 1).alias("shared"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    near = mine.join(both.withColumnRenamed("a", "file"), "file").select("agent", F.col("b").alias("file")).distinct().join(mine, ["agent", "file"], "left_anti")
    related = near.join(many, "file").groupBy("agent").agg(F.count("*").alias("related"))  # whoever changed it is another agent
    return own.join(related, "agent", "left").select("agent", "own", "shared", F.coalesce("related", F.lit(0).cast("long")).alias("related"))


def lines_owned(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Lines in all, by AI and by people, and agents, for each key."""
    n = F.col("end_line") - F.col("start_line") + 1
    ai = F.col("author_type") == "ai"
    return ranges.groupBy(*keys).agg(
        F.sum(n).alias("total_lines"), F.sum(F.when(ai, n).otherwise(0)).alias("ai_lines"), F.sum(F.when(~ai, n).otherwise(0)).alias("human_lines"),
        F.countDistinct(F.when(ai, F.col("agent"))).alias("agents"),
    )


#: Lines of a file that one task sweeps at once.
STRETCH = 100_000


class Later:
    """Authors of edits of the same time and number: the greater one comes first."""

    def __init__(self, author: tuple):
        self.author = author

    def __lt__(self, other: Later) -> bool:
        return self.author > other.author


def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges in order of file, stretch and start as islands of the latest edit; the edits that are open at a line are all that is held."""
    names = ("file", "start_line", "end_line", "author_type", "agent")
    at, line, active, schema = None, 0, [], None

    def emit(upto: int | None) -> None:
        nonlocal line
        while active and (upto is None or line < upto):
            _, _, last, end = active[0]
            if end < line:
                heapq.heappop(active)
                continue
            stop = end if upto is None else min(end, upto - 1)
            if out and out[-1][0] == at[0] and out[-1][2] == line - 1 and out[-1][3:] == list(last.author) and line % STRETCH:
                out[-1][2] = stop
            else:
                out.append([at[0], line, stop, *last.author])
            line = stop + 1

    for b in batches:
        schema, out = pa.schema([pa.field(n, b.schema.field(n).type) for n in names]), []
        for file, stretch, start, end, ts, seq, kind, agent in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (file, stretch) != at:
                if at:
                    emit(None)
                at, line = (file, stretch), start
                active.clear()
            emit(start)
            line = max(line, start) if active else start
            heapq.heappush(active, (-ts, -seq, Later((kind, agent)), end))
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)
    out = []
    if at:
        emit(None)
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)


def consolidated(ranges: DataFrame) -> DataFrame:
    """file, start_line, end_line, author_type, agent: the last writer of each line, runs of the same author as one range.

    A file is cut into stretches of lines, so that a large one is swept by many tasks. A sweep never lists lines: it goes from one start or end of a range
    to the next and holds the edits that are open there. Islands that end with a batch or a stretch are joined to those that go on behind them.
    """
    stretch = lambda c: F.floor(F.col(c) / STRETCH)
    rows = ranges.where("file IS NOT NULL AND start_line <= end_line").withColumn("stretch", F.explode(F.sequence(stretch("start_line"), stretch("end_line"))))
    first, last = F.col("stretch") * STRETCH, (F.col("stretch") + 1) * STRETCH - 1
    rows = rows.select(
        "file", "stretch", F.greatest("start_line", first).cast("long").alias("start_line"), F.least("end_line", last).cast("long").alias("end_line"),
        F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-(1 << 62))).alias("ts"), F.coalesce(F.col("seq").cast("long"), F.lit(-(1 << 62))).alias("seq"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("author_type", "agent")),
    )
    types = dict(rows.dtypes)
    ordered = rows.repartition("file", "stretch").sortWithinPartitions("file", "stretch", "start_line", "end_line")
    islands = ordered.mapInArrow(swept, ", ".join(f"{c} {types[c]}" for c in ("file", "start_line", "end_line", "author_type", "agent")))
    by = W.partitionBy("file", "author_type", "agent").orderBy("start_line")
    new = F.coalesce(F.col("start_line") > F.lag("end_line").over(by) + 1, F.lit(True))
    runs = islands.withColumn("run", F.sum(new.cast("int")).over(by))
    return runs.groupBy("file", "author_type", "agent", "run").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("run")


def not_overlapping(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old ranges (file, start_line, end_line, ...) that no new range of the file overlaps."""
    n = new.select(F.col("file").alias("f"), F.col("start_line").alias("s"), F.col("end_line").alias("e")).distinct()
    return old.join(n, (F.col("file") == F.col("f")) & (F.col("s") <= F.col("end_line")) & (F.col("e") >= F.col("start_line")), "left_anti")


def band_pairs(rows: DataFrame, width: int) -> DataFrame:
    """key, id, other: rows (key, id, at) of one key whose places differ by at most width, id < other. Equi-joined on buckets of the width."""
    own = rows.withColumn("bucket", F.floor(F.col("at") / (width + 1)))
    near = rows.select(F.col("key"), F.col("id").alias("other"), F.col("at").alias("there"), F.explode(F.array(*[F.floor(F.col("at") / (width + 1)) + k for k in (-1, 0, 1)])).alias("bucket"))
    return own.join(near, ["key", "bucket"]).where((F.col("id") < F.col("other")) & (F.abs(F.col("at") - F.col("there")) <= width)).select("key", "id", "other")
