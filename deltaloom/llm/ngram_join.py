"""Similarity join of documents on word shingles by parity sketches.

Each shingle flips one bit of a wide sketch of its document (an XOR over the shingles), so two sketches differ in at most
as many bits as the sets differ in shingles. A sketch is cut into G segments; a segment is kept as the XOR of 64-bit codes
of its set bits. Documents of one size band that reach the threshold differ in at most d shingles; with G > d segments,
they agree in one segment at least (pigeonhole), so an equi-join on (band, segment number, segment) meets every pair that
reaches the threshold. A document joins its own size band and the next ones that hold possible larger partners.

A segment without any shingle says little. G has ``spare`` segments more than d + 1; a document with no more empty segments
than that leaves them out: of at least spare + 1 segments in which a pair agrees, one is not empty then. Documents with
more empty segments join on these too, so nothing is lost.

Documents with the same set are one node. Nothing is expanded into all pairs of a group: in each segment's group every
node is compared with one centre only (map tasks choose local centres first, so that a hot segment reaches its reducer as
one row for each task). Pairs whose whole sketches already differ in too many bits go; the rest is verified on the whole
sets and connected components are taken. What the centres leave open, groups whose nodes still lie in several components,
is settled exactly and without listing its pairs: two nodes of different components are never both in the group's largest
one, so a task holds a block of the nodes outside it and meets all nodes of the group as they stream by. Rounds over whole
sketches, of the nodes that folded ones don't rule out for all partners, join components by pairs that form trees; then only
nodes that still have a plausible partner bring their sets, which the task compares through an index of shingles, and again only joining links leave it. Groups
of more than WIDE nodes that share nodes are one cluster, so that no pair is compared for each segment again. A group of m nodes,
u of them outside its largest component, is read u / BLOCK times, and m * u sketches are compared.

Words are maximal runs of non-space characters (ASCII white space) after lower-casing A to Z. Sets hold 64-bit hashes of
shingles. Defined results: null and blank texts have no shingles and link with nothing; texts with fewer words than a
shingle are one shingle. Rows with a null doc_id link with nothing and have a null component. Rows that repeat a
doc_id are rows of their own, and share a component id if they are linked. An empty table gives an empty result. Other
columns may have any names; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, noted, sent, small_batches, tidy, written

#: Keys that a map task groups at once; nodes of a group from which on it becomes part of a cluster; nodes of a block of sketches, and of sets or of what streams by; rounds by sketches; parts of a task's sort.
FOLD_KEYS, WIDE, BLOCK, PART, ROUNDS, FINE = 250_000, 2048, 1024, 256, 1, 4
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ODD = np.uint64(0x9E3779B97F4A7C15)
ROWS = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("node", pa.int64()), ("other", pa.int64()), ("n", pa.int32())])
DOCUMENT, MEMBER, PAIR = 0, 1, 2
SETS = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("thin", pa.binary()), ("sketch", pa.binary()), ("shingles", pa.binary())])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """Hash of each word, kept while a worker has room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = Hashes()


def forget() -> None:
    WORDS.clear()


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(WORDS.__getitem__, parts), np.uint64, len(parts))
    wide = min(words, len(parts))
    out = np.full(len(parts) - wide + 1, wide, np.uint64)
    for k in range(wide):
        out = mixed(out * ODD + own[k : len(parts) - wide + 1 + k])
    return np.unique(out)


def name_of(own: np.ndarray) -> int:
    """The node of a set, a signed 64-bit number."""
    return int((mixed(own ^ ODD).sum() ^ np.uint64(len(own))).view(np.int64))


@lru_cache(maxsize=8)
def bands(percent: int) -> list[tuple[int, int, int, int]]:
    """(least size, smallest partner, segments, spare) of each band."""
    out, least = [], 1
    while least < 1 << 40:
        following = max(least + 1, least * 4 // 3)
        most = (100 - percent) * 2 * (following - 1) // (100 + percent)
        spare = 2 + most // 25 if most else 0
        out.append((least, -(-least * percent // 100), most + 1 + spare, spare))
        least = following
    return out


def band_keys(own: np.ndarray, percent: int) -> np.ndarray:
    """The join keys of a set: one for each segment of its sketch, in each band that it joins."""
    keys, codes = [], mixed(own + ODD)
    own_band = None
    for number, (least, partner, segments, spare) in enumerate(bands(percent)):
        if len(own) < partner:
            break
        if own_band is None and len(own) >= bands(percent)[number + 1][0]:
            continue
        own_band = number
        at = ((own >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)  # rises with the hash
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        value = np.bitwise_xor.reduceat(codes, starts)
        place = at[starts]
        if segments - len(starts) > spare:
            empty = np.setdiff1d(np.arange(segments, dtype=np.uint64), place)
            place, value = np.r_[place, empty], np.r_[value, np.zeros(len(empty), np.uint64)]
        keys.append(mixed(value ^ mixed((np.uint64(number) << np.uint64(40)) + place + np.uint64(1))))
    return np.concatenate(keys).view(np.int64)


def rows_of(kind: int, key: np.ndarray, node: np.ndarray, other: np.ndarray | None, n: np.ndarray | None = None) -> pa.RecordBatch:
    empty = lambda t: pa.nulls(len(key), t)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key), pa.array(node), empty(pa.int64()) if other is None else pa.array(other), empty(pa.int32()) if n is None else pa.array(n)], schema=ROWS)


def centred(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For (key, node) sorted by both: first row of each key, and for the other rows, if their node is new, its centre."""
    first = np.r_[True, key[1:] != key[:-1]]
    centre = node[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
    new = ~first & np.r_[True, node[1:] != node[:-1]]
    return first, new, centre


def sketched(words: int, percent: int):
    """Map side: documents, members of segments, and pairs of nodes that meet in this task."""

    def folded(keys: list[np.ndarray], nodes: list[int], sizes: list[int]) -> Iterator[pa.RecordBatch]:
        key, node = np.concatenate(keys), np.repeat(np.array(nodes, np.int64), sizes)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        first, new, centre = centred(key, node)
        yield rows_of(MEMBER, key[first], node[first], None)
        if new.any():
            yield rows_of(PAIR, key[new], node[new], centre[new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, sizes, many, passed = [], [], [], 0, 0
        for b in batches:
            docs = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = shingles(text, words)
                node = name_of(own) if len(own) and doc_id is not None else None
                docs.append((node, doc_id, len(own)))
                if node is not None:
                    keys.append(band_keys(own, percent))
                    nodes.append(node)
                    sizes.append(len(keys[-1]))
                    many += sizes[-1]
                if many > FOLD_KEYS:
                    yield from folded(keys, nodes, sizes)
                    keys, nodes, sizes, many = [], [], [], 0
            node, doc, n = zip(*docs, strict=True) if docs else ((), (), ())
            # Documents only pass through the shuffle: their keys are their ids and places, so that copies don't meet in a task.
            place = np.array([d or 0 for d in doc], np.int64).view(np.uint64) + np.arange(passed, passed + len(docs), dtype=np.uint64)
            place, passed = pa.array(mixed(place).view(np.int64)), passed + len(docs)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), DOCUMENT, np.int8)), place, pa.array(node, pa.int64()), pa.array(doc, pa.int64()), pa.array(n, pa.int32())], schema=ROWS)
        if many:
            yield from folded(keys, nodes, sizes)

    return run


def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side, rows in order of key and node: each node of a segment with the segment's first node."""
    last_key, last_centre = None, None
    for b in batches:
        kind = b.column(0).to_numpy()
        rest = pa.array(kind != MEMBER)
        if len(other := b.filter(rest)):
            yield other
        own = b.filter(pa.array(kind == MEMBER))
        if not len(own):
            continue
        key, node = own.column(1).to_numpy(), own.column(2).to_numpy()
        if last_key is not None and key[0] == last_key:
            key, node = np.r_[last_key, key], np.r_[last_centre, node]
        _, new, centre = centred(key, node)
        last_key, last_centre = key[-1], centre[-1]
        if new.any():
            yield rows_of(PAIR, key[new], node[new], centre[new])


def reaches(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def whole_sketch(own: np.ndarray) -> bytes:
    """The parity of the hashes at each of four times as many bits as there are shingles at least, a power of two."""
    bits = max(1024, 4 << (len(own) - 1).bit_length())
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def distance(x: bytes, y: bytes) -> int:
    """Hamming distance of two sketches; the wider one is folded, so this never exceeds the symmetric difference."""
    if len(x) < len(y):
        x, y = y, x
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    for half in (8 * len(y) << k for k in reversed(range((len(x) // len(y)).bit_length() - 1))):
        a = (a >> half) ^ (a & ((1 << half) - 1))
    return (a ^ b).bit_count()


def close(percent: int):
    """Pairs a, b that their sizes and sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "s_a", "s_b"))
            keep = [
                100 * min(i, j) >= percent * max(i, j) and distance(u, v) * (100 + percent) <= (100 - percent) * (i + j)
                for i, j, u, v in zip(n, m, x, y, strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def folded_to(sketches: np.ndarray, words: int) -> np.ndarray:
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


class Forest(dict):
    """Union-find over roots."""

    def top(self, x: int) -> int:
        while (y := self.setdefault(x, x)) != x:
            self[x] = x = self.setdefault(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self[max(x, y)] = min(x, y)
        return x != y


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, list[tuple]]]:
    """Rows in order of cell, those inside first: for each cell (group, True, its inside rows, maybe none), then (group, False, some others), ..."""
    at, held, others, begun = None, [], [], True
    for b in batches:
        for group, block, inside, *row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if (group, block) != at:
                if not begun:
                    yield at[0], True, held
                if others:
                    yield at[0], False, others
                at, held, others, begun = (group, block), [], [], False
            if inside:
                held.append(row)
                continue
            if not begun:
                yield at[0], True, held
                begun = True
            others.append(row)
            if len(others) == PART:
                yield at[0], False, others
                others = []
    if not begun:
        yield at[0], True, held
    if others:
        yield at[0], False, others


def stacked(rows: list[tuple]) -> list[tuple[np.ndarray, ...]]:
    """node, root, n, sketches of the rows of each sketch width."""
    by_width: dict[int, list[tuple]] = {}
    for row in rows:
        by_width.setdefault(len(row[3]), []).append(row)
    out = []
    for width, part in sorted(by_width.items()):
        node, root, n, sketch = zip(*part, strict=True)
        out.append((np.array(node), np.array(root), np.array(n, np.int64), np.frombuffer(b"".join(sketch), np.uint64).reshape(len(part), width // 8)))
    return out


def plausible(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...], percent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Places in both and the share of differing bits of pairs across roots that sizes and sketches don't rule out, a few rows at a time."""
    width = min(one[3].shape[1], two[3].shape[1])
    sketch, sketch2 = folded_to(one[3], width), folded_to(two[3], width)
    step = max(1, (1 << 19) // (len(sketch2) * width))
    for at in range(0, len(sketch), step):
        part = slice(at, at + step)
        a, b = one[2][part, None], two[2][None]
        keep = (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (one[1][part, None] != two[1][None])
        x, y = np.nonzero(keep)
        apart = np.bitwise_count(sketch[at + x] ^ sketch2[y]).sum(1, dtype=np.int64) if len(x) * 8 < keep.size else np.bitwise_count(sketch[part, None] ^ sketch2[None]).sum(2, dtype=np.int64)[x, y]
        both = one[2][at + x] + two[2][y]
        near = apart * (100 + percent) <= (100 - percent) * both
        if near.any():
            yield at + x[near], y[near], (apart / both)[near]


def by_sketch(percent: int, spanning: bool):
    """Cells of rows (group, block, inside, node, root, n, sketch), compared by sizes and sketches.

    spanning: pairs a, b that join the cell's roots to trees, closer pairs of a step first. Else group (a) and node (b) of
    the rows that have a plausible partner.
    """

    def batch(a: list, b: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def compared(base: list, rows: list, trees: Forest, same: bool) -> tuple[list, list]:
        a, b = [], []
        for i, one in enumerate(base):
            for two in rows[i:] if same else rows:
                for x, y, apart in plausible(one, two, percent):
                    if not spanning:
                        a += np.unique(np.r_[one[0][x], two[0][y]]).tolist()
                        continue
                    # The closest pair of each two roots of this step.
                    low, high = np.minimum(one[1][x], two[1][y]), np.maximum(one[1][x], two[1][y])
                    order = np.lexsort((apart, high, low))
                    first = order[np.r_[True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])]]
                    for k in first[np.argsort(apart[first], kind="stable")].tolist():
                        if trees.join(int(low[k]), int(high[k])):
                            u, v = int(one[0][x[k]]), int(two[0][y[k]])
                            a.append(min(u, v))
                            b.append(max(u, v))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, trees = [], Forest()
        for group, inside, rows in cells(batches):
            now = stacked(rows)
            if inside:
                base, trees = now, Forest()
            a, b = compared(base, now, trees, inside)
            if a:
                yield batch(a, b) if spanning else batch([group] * len(set(a)), sorted(set(a)))

    return run


def set_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, thin, sketches, sets = [], [], [], [], []
            for node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = shingles(text, words)
                if len(own) and name_of(own) == node:  # another text of a repeated doc_id is not meant
                    nodes.append(node)
                    sizes.append(len(own))
                    sketches.append(whole_sketch(own))
                    thin.append(folded_to(np.frombuffer(sketches[-1], np.uint64)[None], len(sketches[-1]) // 32).tobytes())
                    sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((nodes, sizes, thin, sketches, sets), SETS, strict=True)], schema=SETS)

    return run


def linked(percent: int):
    """Rows a, b, sets of both: the pairs that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                keep.append(reaches(len(x), len(y), int((large[at] == small).sum()), percent))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs (a, b) that are linked."""
    for c in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")), c)
    pairs = written(pairs.mapInArrow(tidy(close(percent)), "a long, b long"))
    needed = sent(noted(pairs.select("b").distinct()))
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")).join(sent(pairs), "a")
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).join(needed, "b", "left_semi")
    return left.join(right, "b").select("a", "b", "x", "y").mapInArrow(tidy(linked(percent)), "a long, b long")


def by_set(percent: int):
    """Cells of rows (group, block, inside, node, root, set): links a, b that join the cell's roots to trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, inside, rows in cells(batches):
            own = [(node, root, np.frombuffer(data, np.uint64)) for node, root, data in rows]
            if inside:
                held, trees = own, Forest()
            if not held:
                continue
            if inside:
                sizes = np.array([len(x) for _, _, x in held])
                every = np.concatenate([x for _, _, x in held])
                order = np.argsort(every, kind="stable")
                every, who = every[order], np.repeat(np.arange(len(held)), sizes)[order]
            found = []
            for node, root, x in own:
                low, high = np.searchsorted(every, x), np.searchsorted(every, x, "right")
                many = high - low
                hits = np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
                both = np.bincount(who[hits], minlength=len(held))
                found += [(node, held[k][0]) for k in np.flatnonzero(100 * both >= percent * (sizes + len(x) - both)) if held[k][1] != root and trees.join(root, held[k][1])]
            cols = list(zip(*found, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    return run


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """node, root after more links (a, b) between the components of roots (node, root); nodes without a row are their own roots."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    change = noted(components(between)).select(F.col("node").alias("old"), F.col("root").alias("new"))
    every = roots.unionByName(change.select(F.col("old").alias("node"), F.col("old").alias("root"))).distinct()
    return noted(every.join(change, every["root"] == change["old"], "left").select("node", F.coalesce("new", "root").alias("root")))


def in_cells(members: DataFrame, data: DataFrame, columns: list[str], most: int) -> DataFrame:
    """group, block, inside, node, root, columns: for each group of members (group, node, root) with several roots, each block of about so many of the
    nodes outside its largest component with all its nodes, in order of cell and the block's own nodes first."""
    roots = members.groupBy("group", "root").agg(F.count("*").alias("n"))
    heads = roots.groupBy("group").agg(F.max(F.struct("n", "root")).alias("head"), F.sum("n").alias("all"))
    heads = heads.select("group", F.col("head.root").alias("head"), F.ceil((F.col("all") - F.col("head.n")) / most).cast("int").alias("blocks")).where("blocks > 0")
    rows = members.join(sent(noted(heads)), "group")
    rows = rows.withColumn("own", F.when(F.col("root") != F.col("head"), F.pmod(F.xxhash64("node", "group"), "blocks").cast("int")))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    inside = F.coalesce(F.col("own") == F.col("block"), F.lit(False)).alias("inside")
    rows = rows.join(data.select("node", *columns), "node").select("group", "block", inside, "node", "root", *columns)
    return rows.repartition("group", "block").sortWithinPartitions("group", "block", F.col("inside").desc())


def left_open(pairs: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """node, root with the links between components that the comparisons with centres did not find; pairs: key, node, centre; found: node, root."""
    of = lambda c: found.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    tested = pairs.select("node", "centre").distinct().join(of("node"), "node", "left").join(of("centre"), "centre", "left")
    failed = tested.where(F.coalesce("node_root", "node") != F.coalesce("centre_root", "centre")).select("node", "centre")
    open_keys = pairs.join(failed, ["node", "centre"]).select("key").distinct()
    open_pairs = noted(pairs.join(open_keys, "key", "left_semi"))
    if open_pairs.isEmpty():
        return found
    every = open_pairs.select("key", "node").unionByName(open_pairs.select("key", F.col("centre").alias("node"))).distinct()
    # Groups of the same nodes are one, and so are the wide ones that share nodes. The only pair of a group of two has been compared.
    named = noted(every.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("xor")))
    wide = open_pairs.join(named.where(f"n > {WIDE}").select("key"), "key", "left_semi")
    clusters = components(wide.select(F.col("node").alias("a"), F.col("centre").alias("b"))).select("node", F.col("root").alias("group"))
    once = named.where(f"n > 2 AND n <= {WIDE}").groupBy("n", "sum", "xor").agg(F.min("key").alias("key")).select("key")
    few = every.join(once, "key", "left_semi").select("node", F.xxhash64("key", F.lit(1)).alias("group"))
    groups = few.unionByName(clusters.select("node", F.xxhash64("group", F.lit(2)).alias("group")))

    def plausible_members(groups: DataFrame, sketch: str) -> DataFrame:
        """group, node of those that have a partner across components which the sketches don't rule out."""
        marks = in_cells(members(groups), sets, ["n", sketch], BLOCK).mapInArrow(tidy(by_sketch(percent, False)), "a long, b long")
        return noted(marks.select(F.col("a").alias("group"), F.col("b").alias("node")).distinct())

    def members(groups: DataFrame) -> DataFrame:
        return groups.join(found, "node", "left").select("group", "node", F.coalesce("root", "node").alias("root"))

    groups = plausible_members(groups, "thin")  # few are left for wide sketches and sets
    for _ in range(ROUNDS):
        trees = in_cells(members(groups), sets, ["n", "sketch"], BLOCK).mapInArrow(tidy(by_sketch(percent, True)), "a long, b long").distinct()
        links = written(verified(trees, sets, percent))
        if links.isEmpty():
            break
        found = joined(found, links)
    groups = plausible_members(groups, "sketch")
    if groups.isEmpty():
        return found
    return joined(found, written(in_cells(members(groups), sets, ["shingles"], PART).mapInArrow(tidy(by_set(percent)), "a long, b long")))


def similar(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs: components of Jaccard similarity of at least percent / 100."""
    spark = docs.sparkSession
    small_batches(spark, 10_000)  # bytes bound the batches of texts
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "kind byte, key long, node long, other long, n int"
    rows = texts.mapInArrow(tidy(sketched(words, percent), forget), schema)
    # The largest sort of all: each task takes its share in FINE parts, one after another, so that it holds one of them at a time.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(FINE * tasks, "key").sortWithinPartitions("key", "node").mapInArrow(tidy(paired), schema)
    rows = written(rows.coalesce(tasks))
    known = rows.where(F.col("kind") == DOCUMENT).select(F.col("other").alias("doc_id"), "node", "n")
    pairs = rows.where(F.col("kind") == PAIR).select("key", "node", F.col("other").alias("centre"))
    tests = noted(pairs.groupBy("node", "centre").agg(F.count("*").alias("shared")))
    nodes = tests.select("node").unionByName(tests.select(F.col("centre").alias("node"))).distinct()
    first = noted(known.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    sets = written(texts.join(sent(first), "doc_id").select("node", "text").mapInArrow(tidy(set_rows(words), forget), "node long, n int, thin binary, sketch binary, shingles binary"))
    # Each node meets the centre that it shares most segments with first; of the other pairs, those still across components follow.
    ends = lambda df: df.select(F.col("node").alias("a"), F.col("centre").alias("b"))
    likely = tests.groupBy("node").agg(F.max(F.struct("shared", "centre")).alias("x")).select("node", "x.centre")
    roots = noted(components(written(verified(ends(likely), sets, percent))))
    at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    rest = tests.join(likely, ["node", "centre"], "left_anti").join(at("node"), "node", "left").join(at("centre"), "centre", "left")
    rest = rest.where(F.coalesce("node_root", "node") != F.coalesce("centre_root", "centre"))
    roots = joined(roots, written(verified(ends(rest), sets, percent)))
    roots = left_open(pairs, sets, roots, percent)
    # Nodes of one document without a link stand for themselves; the others get the smallest doc_id of their component.
    own = known.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    own = noted(own.join(roots, "node", "left").where("copies > 1 OR root IS NOT NULL").select("node", "doc_id", F.coalesce("root", "node").alias("root")))
    smallest = noted(own.groupBy("root").agg(F.min("doc_id").alias("least")))
    labels = sent(noted(own.join(sent(smallest), "root").select("node", "least")))
    return known.join(labels, "node", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, less those that a linked document with a smaller doc_id stands for.

    Rows that repeat a doc_id go only if all of them have such a document.
    """
    gone = similar(docs, words, percent).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_and(F.col("component_id") < F.col("doc_id")).alias("gone"))
    gone = noted(gone.where("gone").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")))
    return docs.join(sent(gone), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
