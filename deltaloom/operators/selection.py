"""Selection of tests: expansion of unbounded imports by ranked strategies, and coverage reports of three formats as one table.

An unbounded import of a change asks for more tests: those of its module, else those of its package, else all of them. Every strategy's tests are
candidates with its rank, grouped once by import; the least rank that has any is kept, so a strategy costs a join
and no chain of anti-joins. The whole suite is a mark, not a copy of all tests for each import.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.functions.paths import folder
from deltaloom.operators.graph import sent

#: Strategies from the narrowest to the whole suite.
STRATEGIES = ("nearest_module", "package", "full_suite")


def beginnings(path: Column) -> Column:
    """Every folder above a path, the nearest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def in_modules(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """path, module for modules (module, prefix): every module one of whose prefixes is a folder above the path, and depth, how near that is."""
    above = paths.select("path").distinct().where(F.col("path").contains("/")).select("path", F.posexplode(beginnings(F.col("path"))).alias("depth", "prefix"))
    return above.join(sent(modules), "prefix").groupBy("path", "module").agg(F.min("depth").alias("depth"))


def expanded(imports: DataFrame, tests: DataFrame, modules: DataFrame, start: str = "nearest_module", fallback: bool = True) -> DataFrame:
    """change, path, strategy, tests (how many) for the imports (change, path, bounded, allowlisted) that are neither bounded nor allowed.

    tests: path. strategy is null where no strategy that may be used has a test. Without fallback only the first one may be used.
    """
    open_ = imports.where(~F.coalesce("bounded", F.lit(False)) & ~F.coalesce("allowlisted", F.lit(False))).select("change", "path").distinct()
    first = STRATEGIES.index(start)
    last = len(STRATEGIES) - 1 if fallback else first
    tests = tests.select("path").distinct()
    owners = in_modules(tests, modules).groupBy("module").agg(F.count("*").alias("tests"))
    own = in_modules(open_, modules).join(sent(owners), "module").groupBy("path").agg(F.min_by("tests", F.struct("depth", "module")).alias("tests"))
    nearby = tests.groupBy(folder(F.col("path")).alias("dir")).agg(F.count("*").alias("tests"))
    package = open_.select("path").distinct().withColumn("dir", folder(F.col("path"))).join(sent(nearby), "dir").select("path", "tests")
    whole = open_.select("path", F.lit(tests.count()).alias("tests")).distinct().where("tests > 0")
    ranked = own.withColumn("rank", F.lit(0)).unionByName(package.withColumn("rank", F.lit(1))).unionByName(whole.withColumn("rank", F.lit(2)))
    best = ranked.where(F.col("rank").between(first, last)).groupBy("path").agg(F.min(F.struct("rank", "tests")).alias("x"))
    name = F.get(F.array(*map(F.lit, STRATEGIES)), F.col("x.rank"))
    return open_.join(best, "path", "left").select("change", "path", name.alias("strategy"), F.coalesce("x.tests", F.lit(0).cast("long")).alias("tests"))


def report_format(name: Column, content: Column) -> Column:
    """nyc, coveragepy or jacoco by the name of a report, else by what it holds; null for others."""
    return (
        F.when(name.contains("coverage-final"), "nyc").when(name.contains("jacoco"), "jacoco").when(content.contains("<jacoco") | content.contains("<!DOCTYPE report"), "jacoco")
        .when(content.contains('"executed_lines"'), "coveragepy").when(content.contains('"statementMap"'), "nyc")
    )


NYC = "map<string, struct<path: string, statementMap: map<string, struct<start: struct<line: int>>>, s: map<string, bigint>>>"
COVERAGEPY = "struct<files: map<string, struct<executed_lines: array<int>>>>"
JACOCO = "struct<package: array<struct<_name: string, sourcefile: array<struct<_name: string, line: array<struct<_nr: int, _ci: bigint>>>>>>>"


def covered_lines(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, format, path, line, hits) of lines that were run, each once with its most hits, and rejects (report, format) for reports (report, name, content).

    A report is read once, by its own format; it is rejected if the format is unknown or the content does not parse to it.
    """
    kind = report_format(F.col("name"), F.coalesce("content", F.lit("")))
    rows = reports.select("report", kind.alias("format"), "content")
    of = lambda k: F.when(F.col("format") == k, F.col("content"))
    rows = rows.select("report", "format", F.from_json(of("nyc"), NYC).alias("nyc"), F.from_json(of("coveragepy"), COVERAGEPY).alias("py"), F.from_xml(of("jacoco"), JACOCO, {"rowTag": "report", "mode": "PERMISSIVE"}).alias("jacoco"))
    entry = lambda path, line, hits: F.struct(path.alias("path"), line.cast("int").alias("line"), hits.cast("long").alias("hits"))
    nyc = F.flatten(F.transform(F.map_entries("nyc"), lambda f: F.transform(F.map_entries(f["value"]["statementMap"]), lambda s: entry(f["key"], s["value"]["start"]["line"], F.try_element_at(f["value"]["s"], s["key"])))))
    py = F.flatten(F.transform(F.map_entries("py.files"), lambda f: F.transform(f["value"]["executed_lines"], lambda n: entry(f["key"], n, F.lit(1)))))
    jacoco = F.flatten(F.flatten(F.transform("jacoco.package", lambda p: F.transform(p["sourcefile"], lambda f: F.transform(f["line"], lambda x: entry(F.concat_ws("/", F.nullif(p["_name"], F.lit("")), f["_name"]), x["_nr"], x["_ci"]))))))
    lines = rows.select("report", "format", F.coalesce(nyc, py, jacoco).alias("lines"))
    run = lines.select("report", "format", F.explode("lines").alias("x")).where("x.hits > 0 AND x.line IS NOT NULL AND x.path IS NOT NULL")
    return run.groupBy("report", "format", "x.path", "x.line").agg(F.max("x.hits").alias("hits")), lines.where("lines IS NULL").select("report", "format")
