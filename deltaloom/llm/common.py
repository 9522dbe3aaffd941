"""What the operators of this subpackage share: the shared folder, written tables, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts of the operators name it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a narrow table that go to each executor at once; a larger one is joined by a shuffle.
SENT_ROWS = 1_000_000
#: Bytes that a writer of a table holds before they go to the file.
ROW_GROUP = 16 << 20
#: Tasks for each core of the session that write a table of ids.
WAVES = 4
#: Nodes that one task contracts at once.
FOREST = 300_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``; a temporary one where the session names none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch brings into a Python worker; texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "1024")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None] | None = None) -> Callable:
    """The function of a mapInArrow; after its last batch, the worker gives the memory it has freed back to the system.

    forget (of a module, so that it goes by name): drops what run keeps between batches. Workers live on, and each stage would
    add its own to what those before it have kept.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if forget:
                forget()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
            trim(0)

    return whole


def written(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back: lineage ends here and no executor holds the only copy."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def noted(df: DataFrame) -> DataFrame:
    """As written, for tables of ids and numbers that come from such tables: neighbouring partitions go to one file, so that a round leaves few small files.

    Their number grows with the cores of the session; without a shuffle, and nothing changes where there are fewer partitions.
    """
    return written(df.coalesce(WAVES * df.sparkSession.sparkContext.defaultParallelism))


def sent(df: DataFrame) -> DataFrame:
    """A narrow written table, marked for broadcast if it has at most SENT_ROWS rows."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (u, v) of a task as edges from each node to the smallest node that it reaches among them."""
    parent: dict = {}
    schema = None

    def top(x):
        while (y := parent[x]) != x:
            parent[x] = x = parent[y]
        return x

    def out() -> pa.RecordBatch:
        pairs = [(x, r) for x in parent if (r := top(x)) != x]
        cols = list(zip(*pairs, strict=True)) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    for b in batches:
        schema = b.schema
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            x, y = top(u), top(v)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > FOREST:
            yield out()
            parent.clear()
    if parent:
        yield out()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph.

    edges: columns a, b (any orderable type), in any direction, repeats and loops allowed.
    Returns node, root: one row for each node that has an edge to another node; root is the smallest node that
    it can reach. Each task first contracts the edges it holds to stars; then large-star and small-star alternate until
    every child has one parent and no parent is a child. Edges point from a child to a smaller parent. Only parents that are children
    themselves change in the large-star step; they are few after the contraction, so a root with very many children is
    never the key of a shuffle. Each round is written to the shared folder.
    """
    given = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    state = noted(given.mapInArrow(tidy(forest), given.schema).distinct())
    for _ in range(most_rounds):
        low = state.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        inner = noted(low.join(state.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select(F.col("u").alias("v"), "m"))
        if inner.isEmpty() and low.where("n > 1").isEmpty():
            break
        large = state.join(sent(inner), "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        split = large.join(low.where("n > 1"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = noted(low.select("u", F.col("m").alias("v")).unionByName(split).distinct())
    else:
        raise RuntimeError("the components have not settled")
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
