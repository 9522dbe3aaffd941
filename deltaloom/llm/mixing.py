"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all words; no target exceeds
``most`` times its source's words, and the excess is shared again by weight. This water filling is solved exactly from
prefix sums over the sources in order of (limit / weight).

Rates: among all mixes that meet the token constraints, entropy balancing takes the one nearest to the corpus in relative
entropy of tokens. The constraints are the sources' targets, exactly, and softly that each language keeps the share of the words
that it has in the corpus, so that mixing sources does not shift the languages. The dual is convex, with one multiplier for each
source and one for each language, the latter with a ridge of ``RIDGE`` of the language's words (it makes any targets
feasible); its optimum tilts a document's rate to exp(sum of its two multipliers), at most ``most``. Newton iterations solve
the dual: each aggregates the gradient and the Hessian over the documents' sizes (pre-aggregated to one row for each source
and language), solves for the languages with the sources eliminated, and writes the new multipliers. Only the
matrix of the languages, which no amount of documents or sources enlarges, comes to the driver.

Copies: a rate's whole part is taken at once. Extra copies for the fractions go by sequential Poisson sampling: documents
in order of (uniform hash / fraction) are taken while their words fit into what the source still lacks; further passes
fill the rest with documents that fit into it, the last with the one document that comes nearest. Prefix sums run over hash buckets, so no source is summed by one task.
The same input gives the same copies. Multipliers that have not settled when the rounds end are an error, not a mix.

Defined results: null and blank texts have size 0, are taken never, and do not matter to others. A null source is a
source, the last; a null language, or a table without the column lang, is a language. Null doc_ids and repeated rows are documents as any others (rows that agree in doc_id, source, language and
size get numbers among themselves). Very long texts count with all their words; ties go by doc_id, size and number. An empty table gives an empty result. Other columns may have any names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, noted, sent, written

#: Documents that one task of a prefix sum orders, about; weight of the languages' ridge.
BUCKET_ROWS, RIDGE = 500, 0.1
#: Newton steps of the sources' multipliers in each round.
SOURCE_STEPS = 4
#: What tells documents apart.
KEY = ("doc_id", "source", "lang", "size")


def targets(sizes: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """source, source_size, target. sizes: source, source_size, one row for each source."""
    order = W.orderBy(F.col("source").isNull(), "source")  # a row for each source
    rank = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), rank.cast("int")))
    weighed = weighed.withColumn("limit", F.col("source_size").cast("double") * most)
    by_need = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    whole = W.partitionBy()
    done = by_need.rowsBetween(W.unboundedPreceding, W.currentRow)
    levels = weighed.select(
        "*", F.sum("source_size").over(whole).cast("double").alias("all"), F.sum("weight").over(whole).alias("weights"),
        F.sum("limit").over(done).alias("limits"), F.sum("weight").over(done).alias("full"),
    )
    # The level with all sources up to the one before this at their limits; the first that this source's limit reaches is the answer.
    level = (F.col("all") - F.col("limits") + F.col("limit")) / (F.col("weights") - F.col("full") + F.col("weight"))
    levels = levels.withColumn("level", F.when(level * F.col("weight") <= F.col("limit"), level))
    level = F.min(F.when(F.col("level").isNotNull(), F.struct((F.col("limit") / F.col("weight")).alias("at"), "level"))).over(whole)["level"]
    return levels.select("source", "source_size", F.least("limit", F.coalesce(level, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def same(left: DataFrame, right: DataFrame, columns: tuple[str, ...]) -> Column:
    """left and right agree in the columns, nulls included; those of right have names that end in _."""
    on = F.lit(True)
    for c in columns:
        on = on & left[c].eqNullSafe(right[f"{c}_"])
    return on


def renamed(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}_" for c in columns})


def balanced(sizes: DataFrame, goals: DataFrame, most: int, rounds: int) -> DataFrame:
    """source, lang, rate: Newton's method on the dual. sizes: source, lang, words, one row for each cell of both.

    The sources' block of the Hessian is diagonal, so each round eliminates it by sums over the cells; what is left, a row
    and a column for each language, is aggregated to that small matrix, solved, and put back into the sources' steps.
    """
    sizes = sizes.where("words > 0")
    langs = renamed(sizes.groupBy("lang").agg(F.sum("words").alias("lang_words")), ("lang",))
    total, corpus = (x or 0.0 for x in goals.agg(F.sum("target"), F.sum("source_size")).first())
    goals = renamed(goals.select("source", "target").where("target > 0"), ("source",))
    cells = sizes.join(goals, same(sizes, goals, ("source",))).drop("source_")
    cells = cells.join(langs, same(cells, langs, ("lang",))).drop("lang_")
    share = F.col("lang_words") * float(total / max(1, corpus))
    name = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    cells = noted(cells.select("source", "lang", name.alias("name"), "words", "target", "lang_words", share.alias("share"), F.lit(0.0).alias("m_source")))
    of_source = W.partitionBy("source")  # a row for each language
    m_lang: dict[str, float] = {}

    def at_rates(cells: DataFrame) -> DataFrame:
        """got, curve: words taken at the present rates, and their derivative; sum, lack: of the source."""
        by_name = F.create_map(*(F.lit(x) for kv in m_lang.items() for x in kv)) if m_lang else None
        rate = F.exp(F.col("m_source") + (F.lit(0.0) if by_name is None else F.coalesce(F.try_element_at(by_name, F.col("name")), F.lit(0.0))))
        cells = cells.withColumn("rate", rate)
        cells = cells.withColumns({"got": F.col("words") * F.least("rate", F.lit(float(most))), "curve": F.when(F.col("rate") < most, F.col("words") * F.col("rate")).otherwise(0.0)})
        return cells.withColumns({"lack": F.col("target") - F.sum("got").over(of_source), "sum": F.sum("curve").over(of_source)})

    def settled_sources(cells: DataFrame) -> DataFrame:
        """Newton steps of each source's own multiplier."""
        for _ in range(SOURCE_STEPS):
            # Where every rate of a source is at its limit there is no curvature: a step of the gradient's sign leads back if there is any.
            step = F.when(F.abs("lack") <= 1e-13 * F.col("target"), 0.0).when(F.col("sum") > 0, F.col("lack") / F.col("sum")).otherwise(F.signum("lack"))
            cells = at_rates(cells).withColumn("m_source", F.col("m_source") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), step)))
        return cells.select("source", "lang", "name", "words", "target", "lang_words", "share", "m_source")

    for _ in range(rounds):
        cells = noted(settled_sources(cells))
        at = at_rates(cells).withColumn("row", F.collect_list(F.struct("name", "curve")).over(of_source))
        pairs = at.select("*", F.when(F.col("sum") > 0, 1 / F.col("sum")).otherwise(0.0).alias("inverse"), F.explode("row").alias("other"))
        own = F.col("other.name") == F.col("name")
        sums = pairs.groupBy("name", F.col("other.name").alias("other")).agg(
            F.sum(F.col("curve") * F.col("other.curve") * F.col("inverse")).alias("pair"), F.sum(F.when(own, F.col("curve"))).alias("curve"), F.sum(F.when(own, F.col("got"))).alias("got"),
            F.max("share").alias("share"), F.max("lang_words").alias("words"), F.max(F.abs(F.col("lack")) / F.col("target")).alias("miss"),
        ).collect()  # fmt: skip  # the languages' matrix
        if not sums:
            return cells.select("source", "lang", F.lit(0.0).alias("rate"))  # no source has words
        names = sorted({r["name"] for r in sums})
        hessian, gradient = np.zeros((len(names), len(names))), np.zeros(len(names))
        for r in sums:
            i, j = names.index(r["name"]), names.index(r["other"])
            hessian[i, j] -= r["pair"]
            if i == j:
                hessian[i, i] += r["curve"] + RIDGE * r["words"]
                gradient[i] = r["share"] - r["got"] - RIDGE * r["words"] * m_lang.get(names[i], 0.0)
        move = np.clip(np.linalg.solve(hessian, gradient), -0.5, 0.5)
        if np.abs(move).max() < 1e-9 and max(r["miss"] for r in sums) < 1e-9:
            break
        m_lang.update({n: m_lang.get(n, 0.0) + x for n, x in zip(names, move.tolist(), strict=True)})
    else:
        raise RuntimeError("the rates have not settled")
    return at_rates(settled_sources(cells)).select("source", "lang", F.least("rate", F.lit(float(most))).alias("rate"))


def running(rows: DataFrame, value: str, rank: Column, buckets: int) -> DataFrame:
    """before: the sum of value over the rows of the same source with a smaller rank (0 to 1); ties go by row."""
    rows = rows.withColumn("rank", rank).withColumn("bucket", F.least(F.floor(F.col("rank") * buckets), F.lit(buckets - 1)).cast("long"))
    sums = rows.groupBy("source", "bucket").agg(F.sum(value).alias("in"))
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.sum("in").over(W.partitionBy("source").orderBy("bucket")) - F.col("in")).alias("start"))
    order = W.partitionBy("source", "bucket").orderBy("rank", "doc_id", "size", "lang", "nth").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("up_to", F.sum(value).over(order))
    joined = rows.join(sums, rows["source"].eqNullSafe(sums["s"]) & (rows["bucket"] == sums["b"]))
    return joined.withColumn("before", F.col("start") + F.col("up_to") - F.col(value)).drop("s", "b", "start", "up_to", "rank", "bucket")


def language(docs: DataFrame) -> Column:
    return (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string").alias("lang")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, rounds: int = 40, passes: int = 6) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source, lang, rate, nth for each row of docs (columns doc_id, text, source and others, lang if there is one).

    nth tells rows apart that agree in doc_id, source, language and size.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), language(docs), size.alias("size")))
    # Rows that agree are numbered; only those, so that nothing but rare repeats meets in a window.
    rows = rows.groupBy(*KEY).agg(F.count("*").alias("n")).select(*KEY, F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("nth"))
    sizes = noted(rows.groupBy("source", "lang").agg(F.sum(F.col("size")).alias("words")))
    goals = noted(targets(sizes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most))
    rates = renamed(balanced(sizes, goals, most, rounds), ("source", "lang"))
    known = sizes.join(rates, same(sizes, rates, ("source", "lang")), "left").select("source", "lang", F.coalesce("rate", F.lit(0.0)).alias("rate"))
    known = known.join(renamed(goals, ("source",)), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    known = renamed(known, ("source", "lang"))
    taken = rows.join(known, same(rows, known, ("source", "lang"))).drop("source_", "lang_")
    whole = F.floor(F.col("rate") + 1e-9)
    fraction = F.greatest(F.col("rate") - whole, F.lit(0.0))
    # A uniform number from the id: the same for every run, and unlike for rows that agree.
    chance = (F.pmod(F.xxhash64("doc_id", "nth", F.lit(11)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    taken = taken.select("*", whole.cast("long").alias("copies"), fraction.alias("fraction"), chance.alias("chance"))
    taken = written(taken)
    got = taken.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("got"))
    buckets = max(1, taken.count() // BUCKET_ROWS)
    for turn in range(passes + 1):
        left = got.join(goals.select(F.col("source").alias("g"), "target"), F.col("source").eqNullSafe(F.col("g"))).select("g", (F.col("target") - F.col("got")).alias("lack"))
        # A document gets one extra copy at most.
        able = taken.join(left.where("lack >= 1"), F.col("source").eqNullSafe(F.col("g"))).drop("g").where((F.col("size") > 0) & (F.col("copies") < F.floor("rate") + 1) & (F.col("copies") < most) & (F.col("fraction") > 0))
        if turn < passes:  # after the first pass, documents that fit into what it has left
            rank = F.col("chance") / (F.col("chance") + F.col("fraction"))  # rises with chance / fraction
            chosen = running(able.where("size <= lack"), "size", rank, buckets).where(F.col("before") + F.col("size") <= F.col("lack"))
        else:  # at last the one document that brings the source nearest to its target, also from above
            near = F.struct(F.abs(F.col("size") - F.col("lack")).alias("off"), "doc_id", "size", "lang", "nth")
            best = able.where("size < 2 * lack").groupBy("source").agg(F.min(near).alias("x"))
            chosen = best.select("x.doc_id", "source", "x.lang", "x.size", "x.nth")
        chosen = renamed(chosen.select(*KEY, "nth", F.lit(1).alias("extra")), (*KEY, "nth"))
        more = taken.join(chosen, same(taken, chosen, (*KEY, "nth")), "left")
        taken = written(more.withColumn("copies", F.col("copies") + F.coalesce("extra", F.lit(0))).drop("extra", *(f"{c}_" for c in (*KEY, "nth"))))
        got = taken.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("got"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", "lang", "rate", "nth")


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, with all their columns, as often as the mix takes them. Rows that agree in doc_id, source, language and
    size are numbered by the hash of their texts, which decides what each of them is taken for."""
    copies = mix(docs, **how).select(*KEY, "nth", "copies")
    alike = F.count("*").over(W.partitionBy(*KEY))
    copies = renamed(written(copies.withColumn("alike", alike).where("copies > 0")), (*KEY, "nth", "copies", "alike"))
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size")
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), language(docs), size, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    one, many = sent(copies.where("alike_ = 1")), copies.where("alike_ > 1")
    single = row.join(one, same(row, one, KEY)).select("row", "copies_")
    keys = many.select(*(f"{c}_" for c in KEY)).distinct()
    shared = row.join(keys, same(row, keys, KEY), "left_semi").withColumn("nth", F.row_number().over(W.partitionBy(*KEY).orderBy(F.xxhash64("row.text"))).cast("long"))
    shared = shared.join(many, same(shared, many, (*KEY, "nth"))).select("row", "copies_")
    both = single.unionByName(shared).withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), "copies_")))
    return both.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
