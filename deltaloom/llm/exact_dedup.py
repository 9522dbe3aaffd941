"""Exact deduplication by an extendible-hash index on shared files.

A directory of 2^depth slots maps the leading bits of a text's hash to buckets; it doubles while a bucket holds more
texts than its capacity. Each map task first folds its own equal texts into one entry, so a group of copies that holds
a third of all rows reaches its bucket as one entry for each task. An owner task holds a range of hash values: it reads
its entries in hash order, chains the texts that share a hash value, tells them apart by their bytes, and writes the
index to the shared folder. Documents are then looked up in the index by hash alone; only texts whose chain has more
than one link are compared again.

Two texts are equal when they are identical after each run of ASCII white space is replaced by one space; null is empty.

Defined results: null and empty texts are equal. A null doc_id counts as larger than any other, so it stays only in a
group without another id. Rows that repeat a doc_id and a text count in group_size; all of them are marked kept, and
``distinct_rows`` returns one of them. An empty table gives an empty result. Other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_folder, small_batches, tidy, written, SPACE

#: Entries of a bucket before it is split; the largest directory has 2**MOST_DEPTH slots of 12 bytes.
CAPACITY, MOST_DEPTH = 5_000, 16
#: Bytes of texts that a map task folds at once.
FOLD_BYTES = 8 << 20
BLANK = frozenset(b" \t\n\v\f\r")


def squeezed(text: bytes) -> bytes:
    """Each run of ASCII white space as one space."""
    out = b" ".join(text.split())
    if text and text[0] in BLANK:
        out = b" " + out
    return out + b" " if len(out) and text[-1] in BLANK and out != b" " else out


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


class Directory:
    """Slots by leading hash bits; a bucket is (first key, local depth)."""

    def __init__(self, counts: dict[int, int], depth_of_counts: int, capacity: int):
        self.depth, self.slots = 0, [(0, 0)]
        most = depth_of_counts
        todo = [(0, 0)]
        while todo:
            first, local = todo.pop()
            n = sum(counts.get(k, 0) for k in range(first << (most - local), (first + 1) << (most - local)))
            if n <= capacity or local == most:
                continue  # at the largest depth the bucket grows a longer chain of pages instead
            if local == self.depth:
                self.slots = [s for s in self.slots for _ in (0, 1)]
                self.depth += 1
            span = 1 << (self.depth - local - 1)
            for half in (0, 1):
                child = (2 * first + half, local + 1)
                self.slots[child[0] * span : (child[0] + 1) * span] = [child] * span
                todo.append(child)
        number = {b: i for i, b in enumerate(dict.fromkeys(self.slots))}
        self.buckets = [number[s] for s in self.slots]


def hashed(docs: DataFrame, bits: int) -> DataFrame:
    """h: the hash of the normalised text as an unsigned number of so many bits."""
    return docs.withColumn("h", F.shiftrightunsigned(F.xxhash64("norm"), 64 - bits))


def keyed(docs: DataFrame, bits: int) -> DataFrame:
    """doc_id, text, rest (all other columns, so that no name can clash), norm, h."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*rest) if rest else F.struct(F.lit(None).cast("int").alias("none"))
    return hashed(docs.select("doc_id", "text", rest.alias("rest")).withColumn("norm", normalised()), bits)


def directory(narrow: DataFrame, bits: int, capacity: int) -> Directory:
    rows = narrow.count()
    depth = max(1, min(MOST_DEPTH, bits, math.ceil(math.log2(max(2, rows / capacity))) + 2))
    prefix = F.shiftrightunsigned(F.col("h"), bits - depth).cast("int")
    counts = narrow.groupBy(prefix.alias("p")).agg(F.approx_count_distinct("h").alias("n"))  # at most 2**MOST_DEPTH rows
    return Directory({r.p: r.n for r in counts.collect()}, depth, capacity)


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of a map task as one entry with the row of the smallest doc_id and the number of rows."""
    found: dict[bytes, list] = {}
    size, schema = 0, None

    def out() -> pa.RecordBatch:
        cols = list(zip(*found.values(), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    for batch in batches:
        schema = batch.schema
        cols = [c.to_pylist() for c in batch.columns]
        for row in zip(*cols, strict=True):
            key = squeezed((row[3] or "").encode("utf-8", "surrogatepass"))
            old = found.get(key)
            if old is None:
                found[key] = list(row)
                size += len(key)
            else:
                n = old[5] + row[5]
                if row[2] is not None and (old[2] is None or row[2] < old[2]):
                    found[key] = list(row)
                found[key][5] = n
        if size > FOLD_BYTES:
            yield out()
            found, size = {}, 0
    if found:
        yield out()


def chained(with_rows: bool):
    """An owner task: entries come in the order of bucket and hash; each hash value gets a chain of its different texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chain, done = None, {}, []
        schema = None

        def close() -> None:
            for k, (text, row) in enumerate(chain.items()):
                shown = row[3] if with_rows else text.decode("utf-8", "surrogatepass") if len(chain) > 1 else None
                done.append((row[0], row[1], k, len(chain), row[2], row[5], shown, row[4] if with_rows else None))

        def out() -> pa.RecordBatch:
            rest = schema.field(4).type
            types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), rest]
            names = ["bucket", "h", "chain", "chain_length", "keep_id", "group_size", "text", "rest"]
            cols = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=names)

        for batch in batches:
            schema = batch.schema
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (row[0], row[1]) != at:
                    close()
                    at, chain = (row[0], row[1]), {}
                text = squeezed((row[3] or "").encode("utf-8", "surrogatepass"))
                old = chain.get(text)
                if old is None:
                    chain[text] = list(row)
                else:
                    n = old[5] + row[5]
                    if row[2] is not None and (old[2] is None or row[2] < old[2]):
                        chain[text] = list(row)
                    chain[text][5] = n
            if len(done) >= 512:
                yield out()
                done.clear()
        close()
        if done:
            yield out()

    return run


def narrow_rows(docs: DataFrame, bits: int) -> DataFrame:
    """doc_id, h, sha of each document, written once: the directory and the look-up read it."""
    rows = hashed(docs.select("doc_id", normalised().alias("norm")), bits)
    return written(rows.select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha")))


def index(docs: DataFrame, grown: Directory, bits: int, with_rows: bool) -> DataFrame:
    """A row for each different text: bucket, h, chain, chain_length, keep_id, group_size, and the text and other columns if asked for."""
    spark = docs.sparkSession
    slots = spark.createDataFrame([(i, b) for i, b in enumerate(grown.buckets)], "slot int, bucket int")  # at most 2**MOST_DEPTH rows
    rows = keyed(docs, bits)
    rows = rows.withColumn("slot", F.shiftrightunsigned("h", bits - grown.depth).cast("int") if grown.depth else F.lit(0))
    if not with_rows:
        rows = rows.withColumn("rest", F.struct(F.lit(None).cast("int").alias("none")))
    rows = rows.join(F.broadcast(slots), "slot").select("bucket", "h", F.col("doc_id").cast("long").alias("doc_id"), "text", "rest", F.lit(1).cast("long").alias("n"))
    entries = rows.mapInArrow(tidy(folded), rows.schema)
    owners = entries.repartition("bucket").sortWithinPartitions("bucket", "h")
    schema = T.StructType([T.StructField(a, b) for a, b in (("bucket", T.IntegerType()), ("h", T.LongType()), ("chain", T.IntegerType()), ("chain_length", T.IntegerType()), ("keep_id", T.LongType()), ("group_size", T.LongType()), ("text", T.StringType()), ("rest", rows.schema["rest"].dataType))])
    return owners.mapInArrow(tidy(chained(with_rows)), schema)


def exact_groups(docs: DataFrame, bits: int = 63, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs (columns doc_id, text and any others).

    bits: width of the hash; few bits make texts collide, which the chains resolve.
    """
    spark = docs.sparkSession
    small_batches(spark)
    narrow = narrow_rows(docs, bits)
    path = shared_folder(spark)
    index(docs.select("doc_id", "text"), directory(narrow, bits, capacity), bits, False).drop("rest").write.partitionBy("bucket").parquet(path)
    found = spark.read.schema("h long, chain int, chain_length int, keep_id long, group_size long, text string, bucket int").parquet(path)
    out = narrow.join(found.where("chain_length = 1").select("h", "keep_id", "group_size"), "h")
    crowded = found.where("chain_length > 1").select("h", F.col("text").alias("norm"), "keep_id", "group_size")
    if not crowded.isEmpty():
        rows = hashed(docs.select("doc_id", normalised().alias("norm")), bits)
        again = rows.join(crowded, ["h", "norm"]).select("h", "doc_id", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
        out = out.unionByName(again)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def distinct_rows(docs: DataFrame, bits: int = 63, capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs that stay: of equal texts, the one with the smallest doc_id, with all its columns."""
    small_batches(docs.sparkSession)
    narrow = written(hashed(docs.select(normalised().alias("norm")), bits).select("h"))
    kept = index(docs, directory(narrow, bits, capacity), bits, True)
    columns = [F.col("keep_id").cast(docs.schema["doc_id"].dataType).alias("doc_id") if c == "doc_id" else F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return kept.select(*columns)
