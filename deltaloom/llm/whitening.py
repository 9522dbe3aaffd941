"""Whitened embeddings from an exact covariance: residues of the scatter matrix for several primes, put together by the Chinese remainder theorem.

Components become integers floor(64 * x) + 1000000. Each row gets a leading 1, so that the scatter matrix of the rows holds their number and
sums as well. A task reduces its rows modulo each prime to residues around zero and multiplies blocks of them as doubles; a block is so short
that no sum leaves the integers that a double holds exactly. Residues of tasks are added by place and prime, and the few sums, (d + 1)^2 / 2
for each prime whatever the number of rows, come to the driver, where remaindering gives every entry of the scatter as an exact
integer. The covariance is n * scatter - S * S', centred without any rounding, and only then divided into doubles for the
eigenvectors. A pass over the rows measures the covariance of the whitened values, and the last pass writes them out.

Defined results: vectors that are null, empty, or hold null or non-finite entries are dropped, and so are those whose length is not that of most rows
(ties: the longer). Integers are held within +-2^40, entries of +-2^34, which the product of the primes covers for
2^44 rows. Components whose variance is not above the rounding error of the largest one have no whitened values and are left out, so a
single row, or equal rows only, give an empty result. A deviation beyond the range of a long is null. Each row counts as often as it is there;
null and repeated ids stay. Equal eigenvalues come in the order of the solver; in each eigenvector the largest entry is positive.
An empty table gives an empty result. Other columns may have any names and are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import prod, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from .codes import finite
from .common import small_batches, tidy

SCALE, SHIFT, RANGE, COMPONENTS = 64, 1_000_000, 1 << 40, 32
#: Primes and their bits: residues around zero are below 2^20, and BLOCK rows of products below 2^53.
PRIMES, BITS, BLOCK = 6, 21, 4096


def primes(n: int = PRIMES, bits: int = BITS) -> list[int]:
    """The n largest primes of so many bits."""
    out, x = [], (1 << bits) - 1
    while len(out) < n:
        if all(x % q for q in range(3, int(sqrt(x)) + 1, 2)):
            out.append(x)
        x -= 2
    return out


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, x: the integer vectors that are kept, of the usual length."""
    v = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")).where(finite(F.col("v")))
    usual = v.groupBy(F.size("v").alias("n")).count().where("n > 0").orderBy(F.desc("count"), F.desc("n")).head()
    most = float(RANGE)  # before the product and after it, so that nothing leaves the range of a long
    held = lambda x: F.greatest(F.lit(-RANGE), F.least(F.lit(RANGE), F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), x)) * SCALE) + SHIFT)).cast("long")
    return v.where(F.size("v") == (usual["n"] if usual else -1)).select("vec_id", F.transform("v", held).alias("x"))


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def residues(p: int, rows: np.ndarray) -> np.ndarray:
    """The scatter of integer rows modulo p."""
    total = 0
    for at in range(0, len(rows), BLOCK):
        r = rows[at : at + BLOCK] % p
        r = np.where(r > p // 2, r - p, r).astype(np.float64)
        total = (total + (r.T @ r).astype(np.int64)) % p
    return total


def remaindered(sums: list[int], moduli: list[int]) -> int:
    """The integer around zero with these remainders."""
    whole = prod(moduli)
    x = sum(s * (whole // p) * pow(whole // p, -1, p) for s, p in zip(sums, moduli, strict=True)) % whole
    return x - whole if x > whole // 2 else x


def scatter(rows: DataFrame, width: int) -> list[list[int]]:
    """The exact scatter matrix of (1, x), as integers of any size."""
    moduli = primes()
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((width, width), np.int64) for _ in moduli]
        some = False
        for b in batches:
            if len(b):
                some = True
                x = np.concatenate([np.ones((len(b), 1), np.int64), matrix(b.column(0))], 1)
                total = [(t + residues(p, x)) % p for t, p in zip(total, moduli, strict=True)]
        if some:
            place = np.tile(np.arange(len(upper[0]), dtype=np.int32), len(moduli))
            which = np.repeat(np.arange(len(moduli), dtype=np.int32), len(upper[0]))
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(which), pa.array(np.concatenate([t[upper] for t in total]))], names=["place", "prime", "residue"])

    sums = rows.select("x").mapInArrow(tidy(run), "place int, prime int, residue long").groupBy("place", "prime").agg(F.sum("residue").alias("residue"))
    at = np.zeros((len(upper[0]), len(moduli)), object)
    for r in sums.collect():  # (d + 1)(d + 2) / 2 places for each prime
        at[r.place, r.prime] = r.residue
    out = [[0] * width for _ in range(width)]
    for i, j, s in zip(*upper, at, strict=True):
        out[i][j] = out[j][i] = remaindered([int(v) % p for v, p in zip(s, moduli, strict=True)], moduli)
    return out


class Fit:
    """Number of rows, sums, covariance and its eigenvectors; centred: n^2 times the covariance in exact integers."""

    def __init__(self, whole: list[list[int]]):
        self.n, self.sums = whole[0][0], whole[0][1:]
        d = len(self.sums)
        centred = [[self.n * whole[i + 1][j + 1] - self.sums[i] * self.sums[j] for j in range(d)] for i in range(d)]
        square = self.n * self.n
        self.covariance = np.array([[c / square for c in row] for row in centred])  # each quotient is rounded once
        trace = sum(centred[i][i] for i in range(d)) / square
        values, vectors = np.linalg.eigh(self.covariance)
        values, vectors = values[::-1][:COMPONENTS], vectors[:, ::-1][:, :COMPONENTS]
        keep = values > max(values[0], 0) * d * np.finfo(float).eps
        self.values, self.vectors = values[keep], vectors[:, keep]
        self.vectors = self.vectors * np.sign(self.vectors[np.abs(self.vectors).argmax(0), np.arange(self.vectors.shape[1])])
        self.explained = self.values / trace if trace else self.values

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: longs, or integers of any size where a long could be too small."""
        if self.n * int(np.abs(x).max()) < 1 << 61 and max(map(abs, self.sums)) < 1 << 61:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whitened(self, offsets: np.ndarray) -> np.ndarray:
        return (offsets / self.n).astype(np.float64) @ self.vectors / np.sqrt(self.values)


def deviations(offsets: np.ndarray) -> list[int | None]:
    """Sums of squares of the rows, exactly; None beyond a long."""
    if offsets.dtype != object and int(np.abs(offsets).max()) ** 2 * offsets.shape[1] < 1 << 63:
        return (offsets * offsets).sum(1).tolist()
    return [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in row) for row in offsets)]


def departure(rows: DataFrame, fit: Fit) -> float:
    """The largest absolute entry of the covariance of the whitened values minus the identity."""
    held, k = rows.sparkSession.sparkContext.broadcast(fit), len(fit.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            if len(b):
                w = held.value.whitened(held.value.offsets(matrix(b.column(0))))  # the exact mean is gone already
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k, dtype=np.int32)), pa.array(total.ravel() / held.value.n)], names=["place", "part"])

    parts = rows.select("x").mapInArrow(tidy(run), "place int, part double").groupBy("place").agg(F.sum("part").alias("part"))
    unit = (F.col("place") % (k + 1) == 0).cast("double")
    return parts.agg(F.max(F.abs(F.col("part") - unit))).head()[0]


def whitened(vectors: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: up to COMPONENTS rows for each kept row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    rows = integers(vectors)
    schema = StructType([
        rows.schema["vec_id"], StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()),
        StructField("whitened", DoubleType()), StructField("explained", DoubleType()), StructField("identity_error", DoubleType()),
    ])
    one = rows.select(F.size("x").alias("d")).head()
    fit = Fit(scatter(rows, one["d"] + 1)) if one else None
    if fit is None or not len(fit.values):
        return spark.createDataFrame([], schema)
    error, k, held = departure(rows, fit), len(fit.values), spark.sparkContext.broadcast(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = held.value
        for b in batches:
            if not len(b):
                continue
            offsets = f.offsets(matrix(b.column(1)))
            each = np.repeat(np.arange(len(b)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(b))), pa.array(np.full(len(each), f.n)),
                    pa.array(deviations(offsets), pa.int64()).take(pa.array(each)), pa.array(f.whitened(offsets).ravel()), pa.array(np.tile(f.explained, len(b))), pa.array(np.full(len(each), error)),
                ],
                schema.names,
            )

    return rows.mapInArrow(tidy(run), schema)
