"""The driver's tables, and the typed views of a code-history graph that the queries derive from them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession) -> str:
    """A new name below the folder of ``spark.checkpoint.dir``; where the session names none, as in tests, below a temporary one that it is set to."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The table written to the folder of ``spark.checkpoint.dir`` and read back, so that a loop's plan does not grow."""
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def named(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def order_path():
    """Every tenth order is a test file."""
    return F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("tests/ord/"), F.col("o_orderkey").cast("string"), F.lit(".test"))).otherwise(named("ord/", "o_orderkey"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, type, dst: src depends on dst. Orders call customers and parts, customers and suppliers import nations, and so on."""
    t = lambda name: table(spark, sf_dir, name)
    edge = lambda df, src, kind, dst: df.select(src.alias("src"), F.lit(kind).alias("type"), dst.alias("dst"))
    orders = t("orders").select("o_orderkey", "o_custkey", order_path().alias("path"))
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    used = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select("path", "l_partkey").distinct()
    is_test = F.col("path").startswith("tests/")
    used = used.select(F.col("path").alias("src"), F.when(is_test, "TESTS").otherwise("CALLS").alias("type"), named("part/", "l_partkey").alias("dst"))
    return (
        edge(t("nation"), named("nation/", "n_nationkey"), "IMPORTS", named("region/", "n_regionkey"))
        .unionByName(edge(t("customer"), named("cust/", "c_custkey"), "IMPORTS", named("nation/", "c_nationkey")))
        .unionByName(edge(t("supplier"), named("supp/", "s_suppkey"), "IMPORTS", named("nation/", "s_nationkey")))
        .unionByName(edge(lines.select("l_suppkey", "l_partkey").distinct(), named("supp/", "l_suppkey"), "IMPORTS", named("part/", "l_partkey")))
        .unionByName(edge(orders, F.col("path"), "CALLS", named("cust/", "o_custkey")))
        .unionByName(used)
    )


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots (path, lang, digest, content) of the documents: each misses some files, and some texts differ."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("lang", F.lit("none")), F.coalesce("source", F.lit("none")), F.col("doc_id").cast("string"))
    text = F.coalesce("text", F.lit(""))
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat(text, F.lit("\nlast line"))).otherwise(text)
    view = lambda rows, content: rows.select("doc_id", path.alias("path"), "lang", F.sha2(content, 256).alias("digest"), content.alias("content"))
    return view(docs.where("doc_id % 10 <> 0"), text), view(docs.where("doc_id % 10 <> 1"), changed)


def authorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, start_line, end_line, author_type, agent, ts, seq of edits."""
    lines = table(spark, sf_dir, "lineitem")
    start = F.col("l_linenumber").cast("long") * 10
    human = F.col("l_returnflag") == "R"
    return lines.select(
        F.col("l_partkey").alias("file"), start.alias("start_line"), (start + F.col("l_quantity").cast("long") - 1).alias("end_line"),
        F.when(human, "human").otherwise("ai").alias("author_type"), F.when(human, "").otherwise(F.col("l_suppkey").cast("string")).alias("agent"),
        F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "l_returnflag",
    )


#: Categories that the lines of an order stand for, in turn.
KINDS = (
    "FUNCTION_RENAMED API_SURFACE_CHANGED PARAMETER_ADDED PARAMETER_REMOVED FUNCTION_ADDED FUNCTION_REMOVED DEPENDENCY_ADDED DEPENDENCY_REMOVED DEPENDENCY_UPDATED "
    "FUNCTION_BODY_CHANGED IMPORT_ADDED IMPORT_REMOVED CONDITION_CHANGED CONSTANT_UPDATED FEATURE_FLAG_CHANGED CREDENTIAL_CHANGED ENDPOINT_CHANGED TIMEOUT_CHANGED LIMIT_CHANGED RETRY_CONFIG_CHANGED "
    "SCHEMA_FIELD_ADDED SCHEMA_FIELD_REMOVED SCHEMA_FIELD_CHANGED MIGRATION_ADDED JSON_FIELD_ADDED JSON_FIELD_REMOVED JSON_VALUE_CHANGED JSON_ARRAY_CHANGED YAML_KEY_ADDED YAML_KEY_REMOVED YAML_VALUE_CHANGED "
    "FILE_ADDED FILE_DELETED FILE_CONTENT_CHANGED OTHER"
).split()


def signals(spark: SparkSession, sf_dir: str, *more: str, lines: DataFrame | None = None) -> DataFrame:
    """cluster, category, confidence, tag, path, enriched (factor of known parameters or roles) of change signals, and more columns of their lines (all of the table unless given)."""
    lines = lines or table(spark, sf_dir, "lineitem")
    kind = (F.col("l_orderkey") * 3 + F.floor(F.col("l_linenumber") / 3)) % len(KINDS)
    tags = F.array(*map(F.lit, ("breaking", "api", "config", "test", "security")))
    return lines.select(
        F.col("l_orderkey").alias("cluster"), F.get(F.array(*map(F.lit, KINDS)), kind.cast("int")).alias("category"),
        F.round(1 - F.col("l_discount"), 2).cast("decimal(6,2)").alias("confidence"), F.get(tags, (F.col("l_suppkey") % 5).cast("int")).alias("tag"),
        F.concat(named("part/", "l_partkey"), F.when(F.col("l_partkey") % 11 == 0, ".md").otherwise(".go")).alias("path"),
        F.when(F.col("l_quantity") > 40, 1.05).when(F.col("l_quantity") > 25, 1.03).otherwise(1.0).alias("enriched"), *more,
    )


#: Types of parts, as the table has them.
TYPES = "ECONOMY MEDIUM PROMO LARGE SMALL STANDARD".lower().split()


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path of files of five languages that the parts stand for; several parts may be one file."""
    brand, kind, size, key = F.lower(F.translate("p_brand", "#", "")), F.lower("p_type"), F.col("p_size").cast("string"), F.col("p_partkey")
    at = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    path = (
        F.when(key % 5 == 0, at("svc/", brand, "/", kind, "/f", key.cast("string"), ".go"))
        .when(key % 5 == 1, at("web/", brand, "/", kind, "/", F.when(F.col("p_size") % 3 == 0, at("m", size, ".tsx")).when(F.col("p_size") % 3 == 1, "index.ts").otherwise(at("m", size, "/index.js"))))
        .when(key % 5 == 2, at("py/", kind, "/", F.when(F.col("p_size") % 4 == 0, "__init__").otherwise(brand), ".py"))
        .when(key % 5 == 3, at("app/models/", kind, "/", brand, "_x", F.substring(size, 1, 1), ".rb"))
        .otherwise(at("core/src/", brand, "/", F.when(F.col("p_size") % 4 == 0, "mod").otherwise(kind), ".rs"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))


def import_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """importer, source: each line of an order is an import in the file of its part; its numbers say what is imported, in the manner of the file's language."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("size"))
    rows = lines.join(tree(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    brand = F.concat(F.lit("brand"), (F.col("l_orderkey") % 25 + 1).cast("string"))
    kind = F.get(F.array(*map(F.lit, TYPES)), (F.col("l_suppkey") % 6).cast("int"))
    size, way, language = F.col("size").cast("string"), F.col("l_linenumber") % 3, F.col("l_partkey") % 5
    at = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    pick = lambda *ways: F.when(way == 0, ways[0]).when(way == 1, ways[1]).otherwise(ways[2])
    source = (
        F.when(language == 0, pick(at("example/svc/", brand, "/", kind), at("other/mod/", kind), "fmt"))
        .when(language == 1, pick(at("./m", size), at("../", kind, "/m", size), at("../../", brand, "/./", kind)))
        .when(language == 2, pick(at("py.", kind, ".", brand), at("py.", kind, ".Name"), at(kind, ".", brand)))
        .when(language == 3, pick(at("autoload:", F.initcap(kind), "::", F.initcap(brand), "X", F.substring(size, 1, 1)), at(kind, "/", brand, "_x1"), at("autoload:Outer::", F.initcap(kind))))
        .otherwise(pick(at("crate::", brand, "::", kind, "::Name"), at("super::", brand, "::*"), at("mod:", kind)))
    )
    return rows.select(F.col("path").alias("importer"), source.alias("source"))


#: Lines from which on an order is not dealt out as a whole.
MANY = 50_000


def dealt_lines(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The lines of the orders with fewer than MANY lines, dealt out by order, so that what is computed for each order moves them no more; and the lines of the others, if there are any.

    The numbers of a line lie in an array of one struct: the optimiser would otherwise make a shuffle of its own for each choice of columns that is read.
    """
    numbers = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *numbers)
    large = settled(lines.groupBy("l_orderkey").agg(F.count("*").alias("n")).where(F.col("n") >= MANY).select("l_orderkey"))
    some = not large.isEmpty()
    of = lambda how: lines.join(F.broadcast(large), lines["l_orderkey"].eqNullSafe(large["l_orderkey"]), how)  # noqa: E731  at most one in MANY rows
    few = (of("left_anti") if some else lines).select("l_orderkey", F.array(F.struct(*numbers)).alias("x")).repartition("l_orderkey")
    few = few.select("l_orderkey", F.element_at("x", 1).alias("x")).select("l_orderkey", "x.*")
    return [few, of("left_semi")] if some else [few]


def evidence(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """The signals with seq, symbols, old_name, new_name, after_value, module and fq_name: the numbers of a line say what it is evidence of."""
    rows = signals(spark, sf_dir, "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", lines=lines)
    kind, part, supp = F.col("category"), F.col("l_partkey"), F.col("l_suppkey")
    at = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    is_any = lambda *heads: F.coalesce(*(F.when(kind.startswith(h), F.lit(True)) for h in heads), F.lit(False))
    word = F.when(kind == "FEATURE_FLAG_CHANGED", "flag").otherwise(F.lower(F.split(kind, "_")[0]))
    setting = F.when(part % 4 == 0, F.array(at("svc.p", supp % 5, ".", F.upper(word)))).when(part % 4 == 1, F.array(at("p", supp % 5, ".", word))).when(part % 4 == 2, F.array(F.lit("a.b.size")))
    symbols = (
        F.when(is_any("FUNCTION_", "PARAMETER_") & (part % 4 == 0), F.array(at("name:f", part % 50), at("name:g", supp))).when(is_any("FUNCTION_", "PARAMETER_"), F.array(at("name:f", part % 50)))
        .when(is_any("JSON_", "YAML_") & (part % 3 > 0), F.array(at("server.k", part % 9)))
        .when(is_any("FEATURE_", "CREDENTIAL_", "ENDPOINT_", "TIMEOUT_", "LIMIT_", "RETRY_"), setting)
        .when(is_any("SCHEMA_"), F.array(F.when(supp % 2 == 0, at("model:M", part % 7)).otherwise(at("table:t", part % 7, ".c", supp % 5)))).when(is_any("MIGRATION_"), F.array(at("mig_", part)))
    )
    return rows.select(
        "cluster", "category", "confidence", "tag", "path", "enriched", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("seq"),
        F.coalesce(symbols, F.array().cast("array<string>")).alias("symbols"), at("old", part % 20).alias("old_name"), F.when(supp % 3 == 0, "").otherwise(at("new", part % 20)).alias("new_name"),
        at("v", F.col("l_quantity").cast("int")).alias("after_value"), F.when(supp % 5 > 0, at("mod", supp % 3)).alias("module"), F.when(part % 6 > 0, at("pkg.Type", supp % 4, ".m", part % 6)).alias("fq_name"),
    )
