"""Quality of documents by histogram gradient-boosted trees over document statistics.

The statistics come from the whole text, in Arrow batches. Training takes at most ``SAMPLE`` labelled documents (a
documented bound: those with the smallest hashed ids among the rows that are not held out), bins every statistic by its
quantiles, and grows complete trees level by level from histograms of gradients and curvatures of the logistic loss.
The trees are flattened into arrays of features, thresholds and leaves, so scoring walks all documents of a batch through
a tree by numpy indexing, one step for each level.

Defined results: null and empty texts have statistics 0 and are scored like any others. Ignored in training are labels
whose document is missing, null labels and null ids; labels of a repeated doc_id are averaged. With no label at all every score
is 0.5. Rows with null or repeated ids are rows as any others (held_out is null for a null id). An empty table gives an
empty result. Other columns may have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Labelled documents to learn from.
SAMPLE = 10_000
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE, LEAST, SMOOTH = 80, 4, 64, 0.15, 8.0, 1.0
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\r\v\f", "line": b"\n",
    "stop": b".", "comma": b",", "shout": b"!", "ask": b"?", "bar": b"|", "marks": b"#$%&*@^~", "brackets": b"<>{}[]()", "slashes": b"/\\_=+-:;", "quotes": b"\"'`", "high": bytes(range(128, 256)),
}
OF_BYTE = np.full(256, len(CLASSES), np.int64)
for _i, _members in enumerate(CLASSES.values()):
    OF_BYTE[list(_members)] = _i
NAMES = ("bytes", "words", "lines", *CLASSES, "word_mean", "word_spread", "word_short", "word_long", "word_most", "words_distinct", "word_top", "lines_distinct", "line_top", "line_mean", "line_spread", "per_letter")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def statistics(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words, lines = data.split(), data.split(b"\n")
    n = max(1, len(data))
    counts = np.bincount(OF_BYTE[np.frombuffer(data, np.uint8)], minlength=len(CLASSES) + 1) / n
    wide = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    long = np.fromiter(map(len, lines), np.float64, len(lines))
    each, rows = Counter(words), Counter(lines)
    top = max(each.values(), default=0) / max(1, len(words))
    letters = counts[0] + counts[1] + counts[14]
    return [
        np.log1p(len(data)), np.log1p(len(words)), np.log1p(len(lines)), *counts[: len(CLASSES)],
        wide.mean(), wide.std(), (wide <= 3).mean(), (wide >= 10).mean(), wide.max(), len(each) / max(1, len(words)), top,
        len(rows) / len(lines), max(rows.values()) / len(lines), np.log1p(long.mean()), np.log1p(long.std()), (1 - letters) if data else 0.0,
    ]


class Trees:
    """features, cuts: a row for each tree, nodes in level order; leaves: 2**depth values for each tree."""

    def __init__(self, base: float, features: np.ndarray, cuts: np.ndarray, leaves: np.ndarray):
        self.base, self.features, self.cuts, self.leaves = base, features, cuts, leaves

    def scores(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.features.shape[1]
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < inner:  # all are on one level
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees for y between 0 and 1."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(width)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j]) for j in range(width)], axis=1)  # value > cuts[b] iff bin > b
    mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(mean / (1 - mean)))
    total, inner = np.full(n, base), 2**depth - 1
    features, chosen, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = ((node - first)[:, None] * width + np.arange(width)) * BINS + binned
            shape = (many, width, BINS)
            hist_g = np.bincount(at.ravel(), np.repeat(g, width), many * width * BINS).reshape(shape).cumsum(2)
            hist_h = np.bincount(at.ravel(), np.repeat(h, width), many * width * BINS).reshape(shape).cumsum(2)
            all_g, all_h = hist_g[:, :, -1:], hist_h[:, :, -1:]
            gain = hist_g**2 / (hist_h + SMOOTH) + (all_g - hist_g) ** 2 / (all_h - hist_h + SMOOTH) - all_g**2 / (all_h + SMOOTH)
            gain = np.where((hist_h >= LEAST / 4) & (all_h - hist_h >= LEAST / 4), gain, -1)
            best = gain.reshape(many, -1).argmax(1)
            for k in range(many):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-9 and b < len(cuts[j]):
                    features[t, first + k], chosen[t, first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), features[t, node]] > chosen[t, node])
        leaf = node - inner
        sum_g, sum_h = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        leaves[t] = -RATE * sum_g / (sum_h + SMOOTH)
        total += leaves[t, leaf]
    return Trees(base, features, chosen, leaves)


def measured(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """The columns of keep, and statistics (an array)."""
    small_batches(docs.sparkSession)
    kept = docs.select(*keep, F.col("text").alias("text_"))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t) for t in b.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(rows, pa.list_(pa.float64()))], names=[*b.schema.names[:n], "statistics"])

    types = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[:n])
    return kept.mapInArrow(run, f"{types}, statistics array<double>")


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Trees | None:
    """From at most so many labelled documents that are not held out; of rows that repeat an id, the one with the least statistics counts."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.avg("quality").cast("double").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(most)
    rows = measured(docs.join(F.broadcast(known), "doc_id"), [F.col("doc_id"), F.col("y")])
    rows = rows.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("statistics").alias("statistics")).collect()  # `most` documents
    rows = sorted(rows, key=lambda r: r.doc_id)
    if not rows:
        return None
    return grow(np.array([r.statistics for r in rows]), np.clip(np.array([r.y for r in rows]), 0, 1))


def scored(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    trees = learn(docs, labels, most)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column(1).to_pylist()]).reshape(b.num_rows, len(NAMES))
            score = trees.scores(x) if trees else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text_")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
