"""What a purge of files would take away, and what a push sends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.functions.paths import matches_any


def purged_files(files: DataFrame, patterns: list[str]) -> DataFrame:
    """The files (id, path, digest, content_digest) whose path is one of the patterns or matches one; each id once, the smallest row of it. Empty and null paths stay."""
    hit = files.where(F.coalesce(F.col("path") != "", F.lit(False)) & (F.col("path").isin(*patterns) | matches_any(F.col("path"), patterns)))
    return hit.groupBy("id").agg(F.min(F.struct("path", "digest", "content_digest")).alias("x")).select("id", "x.*")


def purge_snapshots(purged: DataFrame, listing: DataFrame, counts: DataFrame) -> DataFrame:
    """snapshot, removed, file_count, listed: snapshots that list a purged file, by its id.

    listing: snapshot, id, path, a row for each file that a snapshot lists, repeats included; counts: snapshot, file_count, one row each. file_count is what the snapshot had less what goes,
    never below 0, and null where it had none; listed is how many of its rows stay in its list of paths, from which purged paths go whatever their ids. The listing is joined to ids and to paths as rows:
    no snapshot is ever one array, and a file that very many snapshots list meets the purged side broadcast or split by adaptive execution.
    """
    ids = purged.select("id", F.lit(1).alias("gone"))
    paths = purged.select("path").distinct().withColumn("off", F.lit(1))
    marked = listing.join(ids, "id", "left").join(paths, "path", "left")
    sums = marked.groupBy("snapshot").agg(F.count("gone").alias("removed"), F.count_if(F.col("off").isNull()).alias("listed")).where("removed > 0")
    left = F.when(F.col("file_count").isNotNull(), F.greatest(F.lit(0).cast("long"), F.col("file_count").cast("long") - F.col("removed")))
    return sums.join(counts, "snapshot", "left").select("snapshot", "removed", left.alias("file_count"), "listed")


def purge_totals(purged: DataFrame, symbols: DataFrame, objects: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row: files, symbols, objects, bytes, snapshots.

    symbols: symbol, id: a symbol of two purged files counts twice, as its edges do. objects: digest, bytes, of the store; a digest of a purged file, named under digest or content_digest, goes once, also
    where files that stay share it; its bytes are 0 where the store has it not.
    """
    digests = purged.select(F.explode(F.array("digest", "content_digest")).alias("digest")).where("digest <> ''").distinct()
    sizes = digests.join(objects.groupBy("digest").agg(F.max("bytes").alias("bytes")), "digest", "left")
    of_files = purged.agg(F.count("*").alias("files"))
    of_symbols = symbols.join(purged.select("id"), "id", "left_semi").agg(F.count("*").alias("symbols"))
    of_objects = sizes.agg(F.count("*").alias("objects"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))
    row = lambda df: df.withColumn("one", F.lit(1))  # noqa: E731  four tables of one row
    whole = row(of_files).join(row(of_symbols), "one").join(row(of_objects), "one").join(row(snapshots.agg(F.count("*").alias("snapshots"))), "one")
    return whole.drop("one")


def push_objects(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """id, kind, content: each asked id (column id, repeats allowed) that is stored, once, with its payload; kind is node for all. Edges are not followed; ids that are not stored are left out."""
    return nodes.join(asked.select("id").distinct(), "id", "left_semi").select("id", F.lit("node").alias("kind"), F.col("payload").alias("content"))


def changeset_graph(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("MODIFIES", "HAS", "AFFECTS", "HAS_INTENT")) -> DataFrame:
    """change, part, key, kind of each stored changeset: itself, the edges of the kinds that leave it (key: where to, kind: their type), and the stored nodes they lead to. Each edge and node is listed once."""
    row = lambda df, part, key, kind: df.select("change", F.lit(part).alias("part"), F.col(key).alias("key"), F.col(kind).alias("kind"))
    own = nodes.where("kind = 'ChangeSet'").select(F.col("id").alias("change"), "id", "kind")
    out = edges.where(F.col("type").isin(*kinds)).join(own.select("change"), F.col("src") == F.col("change")).select("change", "type", F.col("dst").alias("id")).distinct()
    ends = out.select("change", "id").distinct().join(nodes.select("id", "kind"), "id")
    return row(own, "changeset", "id", "kind").unionByName(row(out, "edge", "id", "type")).unionByName(row(ends, "node", "id", "kind"))
