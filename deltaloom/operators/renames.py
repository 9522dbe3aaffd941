"""Renamed functions of a file: removed and added bodies that are alike by edit distance, paired one to one.

Distances count bytes of UTF-8. Candidates are joined by file and band of length: a body that is similar enough to another is in the same band
or in a neighbouring one. Files with very many functions in a band are compared in blocks, so no task holds all pairs of a file. Counts of the
commonest bytes bound the distance from below and leave few pairs to compare; the bounds are exact and lose none. Then rounds
take every pair that is the best one for both of its ends, until none is left; this gives the pairs of a greedy
pass in order of similarity (falling), old name, new name.

Names are unique within a file: of repeated ones the greatest body counts. Empty and null bodies are never renamed. Null paths or names are left out.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.operators.graph import sent
from deltaloom.sources.tables import settled

#: Added bodies of a file and a band that are compared in one block, and the bytes that are counted.
BLOCK, COUNTED = 256, "etaoinsrhldcu _(){}=;.,\n"


def in_bytes(text: Column) -> Column:
    """One character for each byte of the text in UTF-8."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def distance(a: Column, b: Column) -> Column:
    """Edit distance in bytes."""
    return F.levenshtein(in_bytes(a), in_bytes(b))


def similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, 0 if one is empty, else 1 - distance / length of the longer one."""
    longer = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1 - distance(a, b) / longer)


def counts(text: Column) -> Column:
    """How often each counted byte is in a text of one character a byte, and how many others."""
    each = [F.length(text) - F.length(F.replace(text, F.lit(c))) for c in COUNTED]
    return F.array(*each, F.length(text) - reduce(lambda x, y: x + y, each))


def least_distance(a: Column, b: Column) -> Column:
    """A bound on the distance from the counts of both texts: each edit takes one byte away, puts one in, or does both."""
    over = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: F.greatest(i - j, F.lit(0))), F.lit(0), lambda s, v: s + v)
    return F.greatest(over(a, b), over(b, a))


def unmatched(rows: DataFrame, others: DataFrame) -> DataFrame:
    """path, name, body (a character a byte), size, counts of the functions whose names the other version does not have."""
    one = rows.where("path IS NOT NULL AND name IS NOT NULL").groupBy("path", "name").agg(F.max("body").alias("body")).where("body <> ''")
    left = one.join(others.select("path", "name").distinct(), ["path", "name"], "left_anti")
    left = left.select("path", "name", in_bytes(F.col("body")).alias("body"))
    return settled(left.select("path", "name", "body", F.length("body").alias("size"), counts(F.col("body")).alias("counts")))


def similar(removed: DataFrame, added: DataFrame, threshold: float) -> DataFrame:
    """path, old_name, new_name, similarity of the pairs of a file that reach the threshold."""
    band = F.floor(F.ln("size") / (log(1 / threshold) * (1 + 1e-9))).cast("int")
    new = added.withColumn("band", band)
    blocks = settled(new.groupBy("path", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    new = new.join(sent(blocks), ["path", "band"]).withColumn("block", F.pmod(F.xxhash64("name"), "blocks").cast("int"))
    new = new.select("path", "band", "block", F.col("name").alias("new_name"), F.col("body").alias("b"), F.col("size").alias("n"), F.col("counts").alias("y"))
    old = removed.withColumn("band", F.explode(F.array(band - 1, band, band + 1))).join(sent(blocks), ["path", "band"])
    old = old.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    old = old.select("path", "band", "block", F.col("name").alias("old_name"), F.col("body").alias("a"), F.col("size").alias("m"), F.col("counts").alias("x"))
    longer = F.greatest("m", "n")
    most = F.floor((1 - threshold) * longer + 1e-6).cast("int")
    pairs = old.join(new, ["path", "band", "block"]).where(F.abs(F.col("m") - F.col("n")) <= most).where(least_distance(F.col("x"), F.col("y")) <= most)
    apart = F.when(F.col("a") == F.col("b"), 0).otherwise(F.expr(f"levenshtein(a, b, CAST(floor({1 - threshold!r} * greatest(m, n) + 1e-6) AS INT))"))
    return pairs.withColumn("apart", apart).where("apart >= 0").select("path", "old_name", "new_name", F.round(1 - F.col("apart") / longer, 6).alias("similarity")).where(F.col("similarity") >= threshold)


def one_to_one(pairs: DataFrame) -> DataFrame:
    """The pairs that a greedy pass takes, the most similar first. Every round takes at least one of each file that has any left."""
    left, taken = settled(pairs), []
    while not left.isEmpty():
        place = F.struct((-F.col("similarity")).alias("minus"), "old_name", "new_name")
        by_old = left.groupBy("path", "old_name").agg(F.min(place).alias("best")).select("path", "best")
        by_new = left.groupBy("path", "new_name").agg(F.min(place).alias("best")).select("path", "best")
        best = settled(by_old.join(by_new, ["path", "best"]).select("path", "best.old_name", "best.new_name", (-F.col("best.minus")).alias("similarity")))
        taken.append(best)
        left = settled(left.join(best.select("path", "old_name"), ["path", "old_name"], "left_anti").join(best.select("path", "new_name"), ["path", "new_name"], "left_anti"))
    return reduce(DataFrame.unionByName, taken) if taken else left


def renamed(before: DataFrame, after: DataFrame, threshold: float = 0.7) -> DataFrame:
    """path, old_name, new_name, similarity of the renames between two versions (path, name, body)."""
    return one_to_one(similar(unmatched(before, after), unmatched(after, before), threshold))
