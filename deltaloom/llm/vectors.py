"""Near-duplicate vectors by NN-descent: a neighbour graph that is refined through neighbours of neighbours.

Vectors are compared only within their label. Each keeps a list of its K nearest known neighbours. The first lists come
from several orders of the vectors by the signs of random projections: vectors that stand next to each other share as many first signs as
there are vectors of their kind, and meet in a window of fixed size. In
each round a join brings the neighbours of a vector, in both directions, together, compares them with one another and
with it, and keeps the best. Equal vectors of a label are one node with the number of them as its weight, so copies never fill
a list. A full list whose every entry reaches the threshold is saturated and may have lost links to anywhere: blocks of
such vectors are compared with all vectors of their label, which counts their links exactly; of the pairs themselves
only a spanning forest is emitted. Recall is audited on the links between the others, those that the blocks do not
count: of these vectors, the ones whose id is divisible by 50 are compared with every other of their label in blocks. The
recall is the lesser of the mean over these vectors and the share of their links, so that no group hides the loss of another.
Below the wanted recall the graph is refined with longer lists and vectors that meet in other orders, and if the last round is below it too, all vectors are compared in blocks. At last the edges at the threshold are kept, each verified in double
precision. The blocks cost the product of the saturated vectors and all vectors of their label.

Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do vectors without a label;
neither do vectors of different lengths. Equal vectors are ordinary neighbours. Defined results: rows with a null id link
with nothing and have null component and kept false; rows that repeat an id count as one vector of the first of them by value, n_links counts other ids. An
empty table gives an empty result. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, sent, small_batches, tidy, written

#: Neighbours of a list, orders of the first graph with the bits of each and half of a window, rounds, queries of the audit, wanted recall, rows of a block.
K, ORDERS, BITS, WINDOW, ROUNDS, EVERY, RECALL, BLOCK = 12, 16, 40, 24, 3, 50, 0.97, 1024
#: Neighbours in the other direction that one round brings together with a vector's own; later rounds bring others.
REVERSE = 12


def usable(rows: DataFrame) -> DataFrame:
    """id, label, v: unit vectors in double precision that can link at all."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), v.alias("v"))
    top = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))  # scaled first, so that no square overflows
    rows = rows.where(F.size("v") > 0).where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).withColumn("top", top).where("top > 0")
    rows = rows.withColumn("v", F.transform("v", lambda x: x / F.col("top")))
    rows = rows.withColumn("norm", norm)
    return rows.select("id", F.concat_ws("/", "label", F.size("v").cast("string")).alias("label"), F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def projected(seed: int, orders: int):
    """Several sort keys for each vector: label, number of the order, signs of random projections as the bits of a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            vectors, sizes = b.column("v"), np.diff(b.column("v").offsets.to_numpy())
            for size in np.unique(sizes):
                rows = b.filter(pa.array(sizes == size))
                axes = np.random.default_rng([seed, int(size)]).normal(size=(int(size), orders * BITS))
                signs = (matrix(rows.column("v")) @ axes > 0).reshape(len(rows), orders, BITS)
                codes = signs @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([rows.column(0)] * orders), pa.concat_arrays([rows.column(1)] * orders), pa.array(np.repeat(np.arange(orders, dtype=np.int32), n)), pa.array(codes.T.ravel()), pa.concat_arrays([vectors.filter(pa.array(sizes == size))] * orders)],
                    names=["id", "label", "axis", "at", "v"],
                )

    return run


def neighbours(best: dict[int, dict[int, float]], ids: np.ndarray, sims: np.ndarray, k: int) -> None:
    """Keep for each id its k most similar others: sims is a square matrix over ids."""
    n = min(k, len(ids) - 1)
    if n < 1:
        return
    sims = sims.copy()
    np.fill_diagonal(sims, -2)
    near = np.argpartition(-sims, n - 1, axis=1)[:, :n]
    for i, own in enumerate(ids.tolist()):
        entry = best.setdefault(own, {})
        for j in near[i].tolist():
            if ids[j] != own:
                entry[int(ids[j])] = float(sims[i, j])


def emitted(best: dict[int, dict[int, float]], k: int) -> pa.RecordBatch:
    a, b, s = [], [], []
    for own, entry in best.items():
        for other, sim in sorted(entry.items(), key=lambda x: -x[1])[:k]:
            a.append(own)
            b.append(other)
            s.append(sim)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "sim"])


def windows(k: int):
    """Rows in order of label, axis and projection: rows near each other are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail_key, tail_ids, tail = None, np.zeros(0, np.int64), None
        for b in batches:
            best: dict[int, dict[int, float]] = {}
            label, axis, ids = b.column(1).to_pylist(), b.column(2).to_numpy(), b.column(0).to_numpy()
            cuts = [0, *(i for i in range(1, len(label)) if label[i] != label[i - 1] or axis[i] != axis[i - 1]), len(label)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                key = (label[start], axis[start])
                own, vectors = ids[start:end], matrix(b.column(4).slice(start, end - start))
                if key == tail_key:
                    own, vectors = np.r_[tail_ids, own], np.r_[tail, vectors]
                for at in range(0, max(1, len(own) - WINDOW), WINDOW):
                    part = slice(at, at + 2 * WINDOW)
                    neighbours(best, own[part], vectors[part] @ vectors[part].T, k)
                tail_key, tail_ids, tail = key, own[-WINDOW:], vectors[-WINDOW:]
            yield emitted(best, k)

    return run


def trimmed(edges: DataFrame, k: int) -> DataFrame:
    """a, b, sim: the k best of each a. Map tasks keep k of each a already."""
    once = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    order = W.partitionBy("a").orderBy(F.desc("sim"), "b")
    return once.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth")


def local_join(k: int):
    """A hub's vectors, own neighbours and reverse ones, compared with one another. Rows in order of hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best: dict[int, dict[int, float]] = {}
            for ids, vectors in zip(b.column(0), b.column(1), strict=True):
                ids = ids.values.to_numpy()
                vectors = vectors.values.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                neighbours(best, ids, vectors @ vectors.T, k)
            yield emitted(best, k)

    return run


def refined(graph: DataFrame, rows: DataFrame, k: int, turn: int) -> DataFrame:
    """One round: neighbours of neighbours in both directions."""
    forward = graph.select(F.col("a").alias("hub"), F.col("b").alias("id"))
    reverse = graph.select(F.col("b").alias("hub"), F.col("a").alias("id"), F.xxhash64("a", "b", F.lit(turn)).alias("o"))
    reverse = reverse.withColumn("nth", F.row_number().over(W.partitionBy("hub").orderBy("o", "id"))).where(F.col("nth") <= REVERSE).select("hub", "id")
    met = forward.unionByName(reverse).unionByName(rows.select(F.col("id").alias("hub"), "id")).distinct()
    lists = met.join(rows.select("id", "v"), "id").groupBy("hub").agg(F.collect_list(F.struct("id", "v")).alias("m"))  # k + REVERSE + 1 at most
    found = lists.select(F.col("m.id").alias("ids"), F.col("m.v").alias("vs")).mapInArrow(tidy(local_join(k)), "a long, b long, sim double")
    return written(trimmed(graph.unionByName(found), k))


def first_graph(rows: DataFrame, k: int, seed: int = 17, orders: int = ORDERS) -> DataFrame:
    spread = rows.mapInArrow(tidy(projected(seed, orders)), "id long, label string, axis int, at long, v array<double>")
    ordered = spread.repartitionByRange("label", "axis", "at").sortWithinPartitions("label", "axis", "at")
    return written(trimmed(ordered.mapInArrow(tidy(windows(k)), "a long, b long, sim double"), k))


def folded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, the least of the equal vectors; label, v, weight, their number), and key, id of the rows that share a node."""
    key = F.sha2(F.concat_ws("/", "label", F.col("v").cast("string")).cast("binary"), 256).alias("key")
    keyed = rows.select("id", "label", "v", key)
    nodes = written(keyed.groupBy("key").agg(F.min(F.struct("id", "label", "v")).alias("x"), F.count("*").alias("weight")).select("key", "x.id", "x.label", "x.v", "weight"))
    shared = written(nodes.where("weight > 1").select("key", F.col("id").alias("node")))
    return nodes.drop("key"), written(keyed.select("id", "key").join(sent(shared), "key").select("id", "node"))


def forest_of(hits: np.ndarray, ids: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the matrix of ids by base connects, at most one for each of them."""
    n = len(base)
    label = np.arange(n)
    while True:
        of_row = np.where(hits, label, n).min(1)
        new = np.minimum(label, np.where(hits, of_row[:, None], n).min(0))
        if (new == label).all():
            break
        label = new
    linked, moved = np.flatnonzero(of_row < n), np.flatnonzero(label < np.arange(n))
    return np.r_[ids[linked], base[moved]], np.r_[base[of_row[linked]], base[label[moved]]]


def compared(threshold: float, counts_only: bool):
    """Rows in order of cell, the cell's own block first: links of all rows with the block's rows.

    With counts_only: a, null, n for the links of a block's row or of a row that no block holds, and a, b, 0 for edges that connect what is linked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, base = None, [], None
        for b in batches:
            out = []
            cell, inside, ids, vectors = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(), b.column(3)
            weights, asked = b.column(4).to_numpy(), b.column(5).to_numpy(zero_copy_only=False)
            cuts = [0, *(i for i in range(1, len(cell)) if cell[i] != cell[i - 1] or inside[i] != inside[i - 1]), len(cell)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                if cell[start] != at:
                    at, held, base = cell[start], [], None
                own = matrix(vectors.slice(start, end - start))
                if inside[start]:
                    held.append((own, ids[start:end], weights[start:end]))
                elif held:
                    if base is None:
                        base = [np.concatenate(c) for c in zip(*held, strict=True)]
                    sims = own @ base[0].T
                    hits = (sims >= threshold) & (ids[start:end, None] != base[1])
                    if counts_only:
                        of_base, of_rows = weights[start:end] @ hits, hits @ base[2]
                        some, others = np.flatnonzero(of_base), np.flatnonzero((of_rows > 0) & ~asked[start:end])
                        for nodes, n in ((base[1][some], of_base[some]), (ids[start:end][others], of_rows[others])):
                            out.append((nodes, np.full(len(nodes), -1), n))
                        left, right = forest_of(hits, ids[start:end], base[1])
                        out.append((left, right, np.zeros(len(left), np.int64)))
                    else:
                        i, j = np.nonzero(hits)
                        out.append((base[1][j], ids[start:end][i], np.ones(len(i), np.int64)))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
            absent = (cols[2] > 0) if counts_only else np.zeros(len(cols[2]), bool)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64(), mask=absent), pa.array(cols[2], pa.int64())], names=["a", "b", "n"])

    return run


def in_blocks(queries: DataFrame, rows: DataFrame, group: str, threshold: float, counts_only: bool) -> DataFrame:
    """a, b, n: links of each query with all rows of its group; with counts_only, what compared says, in parts.

    queries: id, v, weight and group; rows: also asked, whether the row is a query. Blocks of queries meet all rows of the group, a piece at a time.
    """
    size = queries.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    whole = rows.groupBy(group).agg(F.ceil(F.count("*") / (8 * BLOCK)).cast("int").alias("pieces"))
    plan = written(size.join(whole, group))
    own = queries.withColumn("asked", F.lit(True)).join(plan, group).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("inside", F.lit(True))
    every = rows.join(plan, group).withColumn("piece", F.pmod(F.xxhash64("id", F.lit(1)), "pieces").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("inside", F.lit(False))
    cell = F.concat_ws("|", F.col(group).cast("string"), "block", "piece").alias("cell")
    cells = own.select(cell, "inside", "id", "v", "weight", "asked").unionByName(every.select(cell, "inside", "id", "v", "weight", "asked"))
    return cells.repartition("cell").sortWithinPartitions("cell", F.col("inside").desc()).mapInArrow(tidy(compared(threshold, counts_only)), "a long, b long, n long")


def audited(rows: DataFrame, links: DataFrame, threshold: float) -> float:
    """Recall of links (a, b, each once) among rows: the lesser of the mean over the audited rows that have links and the share of all their links."""
    truth = in_blocks(rows.where(F.col("id") % EVERY == 0), rows.withColumn("asked", F.lit(False)), "label", threshold, False).select("a", "b")
    found = truth.join(links.withColumn("found", F.lit(1)), ["a", "b"], "left")
    each = found.groupBy("a").agg(F.count("*").alias("n"), F.count("found").alias("found"))
    recall = each.agg(F.least(F.avg(F.col("found") / F.col("n")), F.sum("found") / F.sum("n"))).head()[0]
    return 1.0 if recall is None else recall  # none: no audited row has links


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, k: int = K) -> DataFrame:
    """vec_id, n_links, component_id, kept, recall (of the audit, the same in all rows)."""
    small_batches(vectors.sparkSession, 2048)
    rows = usable(vectors)
    rows = written(rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v"))
    rows, copies = folded(rows)
    graph = first_graph(rows, k)
    turn = 0
    while True:
        for _ in range(ROUNDS):
            graph, turn = refined(graph, rows, k, turn), turn + 1
        links = graph.where(F.col("sim") >= threshold)
        # Full lists of links may have lost others, in their own group or outside it.
        full = written(links.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("a").alias("id"), F.lit(True).alias("asked")))
        links = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        few = written(links.join(full.select(F.col("id").alias("a")), "a", "left_anti").join(full.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b"))
        recall = audited(rows.join(full, "id", "left_anti"), few, threshold)
        if recall >= RECALL or turn > 4 * ROUNDS:
            break
        k *= 2  # longer lists see further, and so do orders of other projections
        graph = written(trimmed(graph.unionByName(first_graph(rows, k, 17 + turn)), k))
    if recall < RECALL:  # no list is trusted
        full, few, recall = rows.select("id", F.lit(True).alias("asked")), few.limit(0), 1.0
    # Links of saturated vectors are counted, not listed; those of two others come from the lists.
    flagged = written(rows.join(full, "id", "left").withColumn("asked", F.coalesce("asked", F.lit(False))))
    many = written(in_blocks(flagged.where("asked").drop("asked"), flagged, "label", threshold, True))
    few = written(exact(few, rows, threshold))
    roots = written(components(few.select("a", "b").unionByName(many.where("b IS NOT NULL").select("a", "b"))))
    counts = many.where("b IS NULL").select("a", "n").unionByName(few.join(rows.select(F.col("id").alias("b"), "weight"), "b").select("a", F.col("weight").alias("n"))).groupBy("a").agg(F.sum("n").alias("n"))
    nodes = rows.select(F.col("id").alias("node"), "weight").join(counts.withColumnRenamed("a", "node"), "node", "left").join(roots, "node", "left")
    nodes = written(nodes.select("node", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("root", "node").alias("root"), "weight"))
    shared = written(nodes.where("weight > 1").drop("weight"))
    values = nodes.where("weight = 1").select("node", "n", "root").unionByName(copies.join(sent(shared), "node").select(F.col("id").alias("node"), "n", "root"))
    placed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    placed = placed.join(values.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("root", "vec_id")
    return placed.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.lit(recall).alias("recall"))


def exact(pairs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose cosine reaches the threshold."""
    left, right = (rows.select(F.col("id").alias(c), F.col("v").alias(f"v_{c}")) for c in "ab")
    dot = F.aggregate(F.zip_with("v_a", "v_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pairs.join(left, "a").join(right, "b").where(dot >= threshold).select("a", "b")
