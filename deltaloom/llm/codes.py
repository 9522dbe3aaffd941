"""Vector codes of four bytes: integer product quantisation by Lloyd rounds over the distinct parts.

Vectors become integers floor(1024 * x) and are cut into four equal parts. At each part position equal parts are folded into one row with
its weight, so copies cost nothing in the rounds. A codebook has at most 256 entries a position, a size that no data changes; it
goes to every task with the round. A task assigns its distinct parts to the nearest entries by exact integer arithmetic
and sums them up by entry, weighted; the sums meet by position and entry. After the rounds each distinct part has its code and error, and
a join brings them back to the vectors. Parts and labels that many rows share are joined by a broadcast of
those few, the others by a shuffle, so no key with many rows lands in one task.

Defined results: vectors that are null, or hold null or non-finite components, are dropped. So are vectors whose number of
components is zero, no multiple of four, or not that of most rows (ties: the larger), which have no parts to compare. Integers are
held within +-2^24 (components of +-16384), which keeps all squares exact. Ties of a distance go to the lower index. Rows that
repeat an id are vectors of their own, ordered by value among themselves; null ids come last. With fewer than 256 rows the
codebooks have as many entries as rows. An empty table gives an empty result. Other columns may have any names and are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SENT_ROWS, small_batches, tidy, written

PARTS, ENTRIES, ROUNDS, SCALE, RANGE = 4, 256, 4, 1024, 1 << 24
#: A key with more than this share of the rows is joined by broadcast; there are at most as many such keys.
SHARE = 2048


def finite(v: Column) -> Column:
    """Whether an array of doubles is there and holds numbers only."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def integers(vectors: DataFrame) -> DataFrame:
    """row, vec_id, label, x: the integer vectors that are kept, written."""
    v = vectors.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v")).where(finite(F.col("v")))
    held = lambda x: F.greatest(F.lit(-RANGE), F.least(F.lit(RANGE), F.floor(x * SCALE))).cast("int")
    rows = written(v.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform("v", held).alias("x")))
    usual = rows.groupBy(F.size("x").alias("n")).count().where((F.col("n") > 0) & (F.col("n") % PARTS == 0)).orderBy(F.desc("count"), F.desc("n")).head()
    return rows.where(F.size("x") == (usual["n"] if usual else -1))


def parts_of(rows: DataFrame, dims: int) -> DataFrame:
    """row, vec_id, label, pos, part: each vector in PARTS rows."""
    size = dims // PARTS
    cut = F.array(*(F.slice("x", 1 + p * size, size) for p in range(PARTS)))
    return rows.select("row", "vec_id", "label", F.posexplode(cut).alias("pos", "part"))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and squared distance of each row, exactly; the lower index of equal ones."""
    most = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * most * most * x.shape[1] < 1 << 53 else np.int64  # sums of doubles are exact below 2^53
    a, b = x.astype(kind), book.astype(kind)
    apart = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    at = apart.argmin(1)
    return at, apart[np.arange(len(x)), at].astype(np.int64)


def by_position(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """pos, places in the batch and parts as a matrix."""
    pos = batch.column("pos").to_numpy()
    parts = batch.column("part").flatten().to_numpy().reshape(len(pos), -1).astype(np.int64) if len(pos) else None
    for p in np.unique(pos):
        here = np.flatnonzero(pos == p)
        yield int(p), here, parts[here]


def moved(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: floors of the weighted means; entries without parts stay."""
    size = books.shape[2]
    held = distinct.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books_shape, np.int64), np.zeros(books_shape[:2], np.int64)
        for b in batches:
            weight = b.column("weight").to_numpy()
            for p, here, x in by_position(b):
                at, _ = nearest(x, held.value[p])
                np.add.at(total[p], at, x * weight[here, None])
                np.add.at(count[p], at, weight[here])
        pos, entry = np.nonzero(count)
        rows = total[pos, entry]
        yield pa.RecordBatch.from_arrays(
            [pa.array(pos.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[pos, entry]), pa.array(list(rows), pa.list_(pa.int64()))], names=["pos", "entry", "n", "total"]
        )

    books_shape = books.shape
    part = distinct.mapInArrow(tidy(sums), "pos int, entry int, n long, total array<long>")
    whole = part.groupBy("pos", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[j]) for j in range(size))).alias("total"))
    books = books.copy()
    for r in whole.collect():  # PARTS * ENTRIES rows at most
        books[r.pos, r.entry] = [t // r.n for t in r.total]
    held.unpersist()
    return books


def assigned(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """pos, part, weight, entry, apart of each distinct part, written."""
    held = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            entry, apart = np.zeros(len(b), np.int32), np.zeros(len(b), np.int64)
            for p, here, x in by_position(b):
                entry[here], apart[here] = nearest(x, held.value[p])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("pos", "part", "weight")), pa.array(entry), pa.array(apart)], names=["pos", "part", "weight", "entry", "apart"])

    return written(distinct.mapInArrow(tidy(run), "pos int, part array<int>, weight long, entry int, apart long"))


def found(rows: DataFrame, values: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """rows joined to values, one for each key, with the number of rows of the key in weight: heavy keys by broadcast, the others by a shuffle."""
    heavy = F.col(weight) * SHARE > total
    few = F.broadcast(values.where(heavy).drop(weight))  # SHARE keys at most
    rest = rows.join(few.select(*keys), keys, "left_anti")
    return rows.join(few, keys).unionByName(rest.join(values.where(~heavy).drop(weight), keys))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(vectors: DataFrame) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of the kept rows of vectors (vec_id, embedding, label)."""
    small_batches(vectors.sparkSession, 4096)
    rows = integers(vectors)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).select("x").collect()  # the start of the codebooks
    dims = len(first[0].x) if first else PARTS
    books = np.array([r.x for r in first], np.int64).reshape(len(first), PARTS, dims // PARTS).transpose(1, 0, 2)
    parts = parts_of(rows, dims)
    distinct = written(parts.groupBy("pos", "part").agg(F.count("*").alias("weight")))
    if first:
        for _ in range(ROUNDS):
            books = moved(distinct, books)
    total = rows.count()
    each = found(parts, assigned(distinct, books), ["pos", "part"], "weight", PARTS * total)
    two_digits = lambda p: F.lpad(F.lower(F.hex(F.max(F.when(F.col("pos") == p, F.col("entry"))))), 2, "0")
    whole = each.groupBy("row", "vec_id", "label").agg(F.concat(*map(two_digits, range(PARTS))).alias("code"), F.sum("apart").alias("error"))
    whole = written(whole.withColumn("group", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))))
    labels = written(whole.groupBy("group").agg(F.sum("error").alias("label_error"), F.count("*").alias("weight")))
    small = labels.count() <= SENT_ROWS
    out = whole.join(F.broadcast(labels), "group") if small else found(whole, labels, ["group"], "weight", total)
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
