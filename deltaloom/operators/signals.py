"""Change signals (cluster, category, confidence, tag, path): weights, cohesion, types, templates and confidence of clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How much a category weighs; others weigh 0.1.
WEIGHTS = {
    "FUNCTION_RENAMED": 0.9, "API_SURFACE_CHANGED": 0.9, "PARAMETER_ADDED": 0.85, "PARAMETER_REMOVED": 0.85, "FUNCTION_ADDED": 0.8, "FUNCTION_REMOVED": 0.8,
    "DEPENDENCY_ADDED": 0.75, "DEPENDENCY_REMOVED": 0.75, "DEPENDENCY_UPDATED": 0.7, "FUNCTION_BODY_CHANGED": 0.6, "IMPORT_ADDED": 0.5, "IMPORT_REMOVED": 0.5,
    "CONDITION_CHANGED": 0.5, "CONSTANT_UPDATED": 0.4, "FEATURE_FLAG_CHANGED": 0.7, "CREDENTIAL_CHANGED": 0.85, "ENDPOINT_CHANGED": 0.6, "TIMEOUT_CHANGED": 0.55,
    "LIMIT_CHANGED": 0.55, "RETRY_CONFIG_CHANGED": 0.5, "SCHEMA_FIELD_ADDED": 0.8, "SCHEMA_FIELD_REMOVED": 0.85, "SCHEMA_FIELD_CHANGED": 0.8, "MIGRATION_ADDED": 0.9,
    "JSON_FIELD_ADDED": 0.3, "JSON_FIELD_REMOVED": 0.3, "JSON_VALUE_CHANGED": 0.2, "JSON_ARRAY_CHANGED": 0.2, "YAML_KEY_ADDED": 0.3, "YAML_KEY_REMOVED": 0.3,
    "YAML_VALUE_CHANGED": 0.2, "FILE_ADDED": 0.5, "FILE_DELETED": 0.5, "FILE_CONTENT_CHANGED": 0.1,
}
#: Templates with their priorities, confidences and conditions. A condition is a category that is there, a
#: (category, comparator, count), a tag as #tag, or a type of cluster as @type.
TEMPLATES = (
    ("rename_function", 100, 0.95, ["FUNCTION_RENAMED"]),
    ("add_single_function", 95, 0.92, [("FUNCTION_ADDED", "eq", 1), ("FUNCTION_REMOVED", "eq", 0)]),
    ("remove_single_function", 95, 0.92, [("FUNCTION_REMOVED", "eq", 1), ("FUNCTION_ADDED", "eq", 0)]),
    ("add_multiple_functions", 90, 0.90, [("FUNCTION_ADDED", "gt", 1), ("FUNCTION_REMOVED", "eq", 0)]),
    ("refactor_functions", 85, 0.88, ["FUNCTION_ADDED", "FUNCTION_REMOVED"]),
    ("update_api_parameters", 80, 0.85, ["PARAMETER_ADDED"]),
    ("update_api_parameters_removed", 80, 0.85, ["PARAMETER_REMOVED"]),
    ("update_api_surface", 75, 0.80, ["API_SURFACE_CHANGED"]),
    ("add_dependency", 75, 0.90, [("DEPENDENCY_ADDED", "eq", 1), ("DEPENDENCY_REMOVED", "eq", 0)]),
    ("remove_dependency", 75, 0.90, [("DEPENDENCY_REMOVED", "eq", 1), ("DEPENDENCY_ADDED", "eq", 0)]),
    ("update_dependency", 75, 0.90, [("DEPENDENCY_UPDATED", "eq", 1)]),
    ("update_dependencies", 70, 0.85, [("DEPENDENCY_UPDATED", "gt", 1)]),
    ("modify_function", 65, 0.75, ["FUNCTION_BODY_CHANGED"]),
    ("update_imports", 60, 0.70, ["IMPORT_ADDED"]),
    ("modify_condition", 55, 0.65, ["CONDITION_CHANGED"]),
    ("update_constant", 50, 0.60, ["CONSTANT_UPDATED"]),
    ("add_file", 50, 0.80, ["FILE_ADDED"]),
    ("remove_file", 50, 0.80, ["FILE_DELETED"]),
    ("update_json_config", 45, 0.55, ["JSON_VALUE_CHANGED"]),
    ("update_yaml_config", 45, 0.55, ["YAML_VALUE_CHANGED"]),
    ("update_tests", 40, 0.60, ["@test"]),
    ("update_config", 35, 0.55, ["@config"]),
    ("toggle_feature_flag", 72, 0.85, ["FEATURE_FLAG_CHANGED"]),
    ("update_timeout", 68, 0.80, ["TIMEOUT_CHANGED"]),
    ("update_limit", 68, 0.80, ["LIMIT_CHANGED"]),
    ("update_retry_config", 65, 0.78, ["RETRY_CONFIG_CHANGED"]),
    ("update_endpoint", 67, 0.80, ["ENDPOINT_CHANGED"]),
    ("update_credential", 78, 0.88, ["CREDENTIAL_CHANGED"]),
    ("add_schema_field", 82, 0.90, ["SCHEMA_FIELD_ADDED"]),
    ("remove_schema_field", 82, 0.90, ["SCHEMA_FIELD_REMOVED"]),
    ("update_schema_field", 80, 0.88, ["SCHEMA_FIELD_CHANGED"]),
    ("add_migration", 88, 0.92, ["MIGRATION_ADDED"]),
    ("update_auth_flow", 76, 0.85, ["#security", "FUNCTION_BODY_CHANGED"]),
    ("update_permissions", 74, 0.82, ["#security"]),
    ("update_file", 20, 0.40, ["FILE_CONTENT_CHANGED"]),
    ("generic_update", 0, 0.30, []),
)
#: Categories by what they do to confidence, to a cluster's type and to its mixture.
BOOSTS = ((1.15, ("FUNCTION_RENAMED",)), (1.12, ("SCHEMA_FIELD_ADDED", "SCHEMA_FIELD_REMOVED", "SCHEMA_FIELD_CHANGED", "MIGRATION_ADDED")), (1.10, ("FEATURE_FLAG_CHANGED", "CREDENTIAL_CHANGED")),
          (1.08, ("DEPENDENCY_ADDED", "DEPENDENCY_REMOVED", "DEPENDENCY_UPDATED", "PARAMETER_ADDED", "PARAMETER_REMOVED")))
ADDS = ("FUNCTION_ADDED", "FILE_ADDED", "DEPENDENCY_ADDED", "IMPORT_ADDED")
REMOVES = ("FUNCTION_REMOVED", "FILE_DELETED", "DEPENDENCY_REMOVED", "IMPORT_REMOVED")
CHANGES = ("FUNCTION_BODY_CHANGED", "FUNCTION_RENAMED", "CONDITION_CHANGED", "CONSTANT_UPDATED")
DOCS = (".md", ".txt", ".rst", ".adoc")
CONFIG = ("JSON_VALUE_CHANGED", "JSON_FIELD_ADDED", "JSON_FIELD_REMOVED", "YAML_VALUE_CHANGED", "YAML_KEY_ADDED", "YAML_KEY_REMOVED",
          "FEATURE_FLAG_CHANGED", "TIMEOUT_CHANGED", "LIMIT_CHANGED", "RETRY_CONFIG_CHANGED", "ENDPOINT_CHANGED", "CREDENTIAL_CHANGED")
SCHEMA = ("SCHEMA_FIELD_ADDED", "SCHEMA_FIELD_REMOVED", "SCHEMA_FIELD_CHANGED", "MIGRATION_ADDED")
DEPENDENCIES = ("DEPENDENCY_ADDED", "DEPENDENCY_REMOVED", "DEPENDENCY_UPDATED")
#: Tags that a category brings with it.
TAGS = (
    ("api", ("API_SURFACE_CHANGED", "PARAMETER_ADDED", "PARAMETER_REMOVED", "FUNCTION_RENAMED")), ("breaking", ("FUNCTION_REMOVED", "PARAMETER_REMOVED", "DEPENDENCY_REMOVED", "SCHEMA_FIELD_REMOVED")),
    ("security", ("CREDENTIAL_CHANGED",)), ("tuning", ("TIMEOUT_CHANGED", "LIMIT_CHANGED", "RETRY_CONFIG_CHANGED")), ("feature-flag", ("FEATURE_FLAG_CHANGED",)),
    ("config", ("ENDPOINT_CHANGED",)), ("schema", SCHEMA),
)
#: Categories whose evidence is of high or of medium quality; others are low.
HIGH = ("FUNCTION_RENAMED", *SCHEMA, "FEATURE_FLAG_CHANGED", "CREDENTIAL_CHANGED")
MEDIUM = (*DEPENDENCIES, "PARAMETER_ADDED", "PARAMETER_REMOVED", "API_SURFACE_CHANGED", "TIMEOUT_CHANGED", "LIMIT_CHANGED", "ENDPOINT_CHANGED")
#: What names of test files begin or end with, and what names of configuration files end with.
TEST_NAMES = ("_test.go", ".test.js", ".test.ts", ".spec.js", ".spec.ts", "test_", "_test.py", "_spec.rb", "_test.rb")
CONFIG_NAMES = ("package.json", "tsconfig.json", "jest.config", "webpack.config", ".eslintrc", ".prettierrc", "Makefile", "Dockerfile", ".yaml", ".yml", ".toml", ".ini", ".env")
COHESIVE = 0.5
#: Tags that templates, types of clusters and warnings ask for.
MEANT = ("test", "config", "security", "breaking")


def weighted(signals: DataFrame) -> DataFrame:
    """category, n, weight: total weight of each category."""
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("category")), F.lit(0.1))
    return signals.groupBy("category").agg(F.count("*").alias("n")).select("category", "n", weight.alias("weight"))


def tags_of(category: Column) -> Column:
    """The tags that a category brings with it."""
    return F.array_compact(F.array(*(F.when(category.isin(*kinds), F.lit(tag)) for tag, kinds in TAGS)))


def path_tags(path: Column) -> Column:
    """test for a path that begins or ends like a test file, config for one that ends like a configuration file."""
    either = reduce(lambda a, b: a | b, (F.endswith(path, F.lit(x)) | F.startswith(path, F.lit(x)) for x in TEST_NAMES))
    ends = reduce(lambda a, b: a | b, (F.endswith(path, F.lit(x)) for x in CONFIG_NAMES))
    return F.array_compact(F.array(F.when(either, "test"), F.when(ends, "config")))


def quality_of(category: Column) -> Column:
    """Quality of a category's evidence: 3 high, 2 medium, 1 low."""
    return F.when(category.isin(*HIGH), 3).when(category.isin(*MEDIUM), 2).otherwise(1)


def clusters(signals: DataFrame) -> DataFrame:
    """One row for each cluster: n, files, kinds, c (sum of confidences), log, doc, counts of the known categories (c_NAME) and of the tags with a meaning (t_name), and the largest counts.

    signals have a tag, or tags (an array), and may have enriched: the product of the factors for known parameters and roles. Each signal is counted under its category, its tag and its path in one
    aggregation, which map tasks begin; a second one brings the counts of a cluster into one row. Nothing is gathered in arrays.
    """
    enriched = F.col("enriched") if "enriched" in signals.columns else F.lit(1.0)
    no_log, no_c = F.lit(0.0), F.lit(0).cast(signals.schema["confidence"].dataType)
    under = lambda what, name, c, log: F.struct(F.lit(what).alias("what"), name.alias("name"), c.alias("c"), log.alias("log"))
    each = F.array(under("category", F.col("category"), F.col("confidence"), F.ln(enriched)), under("path", F.col("path"), no_c, no_log))
    tags = F.col("tags") if "tags" in signals.columns else F.array("tag")
    each = F.concat(each, F.transform(tags, lambda t: under("tag", t, no_c, no_log)))
    counts = signals.select("cluster", F.explode(each).alias("x")).groupBy("cluster", "x.what", "x.name").agg(F.count("*").alias("k"), F.sum("x.c").alias("c"), F.sum("x.log").alias("log"))
    of = lambda what: F.col("what") == what
    number = lambda what, name: F.coalesce(F.sum(F.when(of(what) & (F.col("name") == name), F.col("k"))), F.lit(0).cast("long"))
    is_doc = reduce(lambda a, b: a | b, (F.endswith(F.col("name"), F.lit(x)) for x in DOCS))
    return counts.groupBy("cluster").agg(
        F.sum(F.when(of("category"), F.col("k"))).alias("n"), F.count_if(of("path") & F.col("name").isNotNull()).alias("files"), F.count_if(of("category") & F.col("name").isNotNull()).alias("kinds"),
        F.sum("c").cast("double").alias("c"), F.sum("log").alias("log"), F.coalesce(F.bool_or(of("path") & is_doc), F.lit(False)).alias("doc"),
        F.max(F.when(of("category"), F.col("k"))).alias("most_category"), F.max(F.when(of("tag"), F.col("k"))).alias("most_tag"),
        *(number("category", c).alias(f"c_{c}") for c in WEIGHTS), *(number("tag", t).alias(f"t_{t}") for t in MEANT),
    )


def count_of(field: str, name: str) -> Column:
    """How many signals of the cluster have this category or tag."""
    return F.col(f"{field[0]}_{name}")


def any_of(kinds: tuple[str, ...]) -> Column:
    return sum_of(kinds) > 0


def sum_of(kinds: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, (count_of("category", c) for c in kinds))


def cohesion_of() -> Column:
    value = 0.3 * F.col("most_category") / F.col("n") + 0.3 / F.greatest(F.lit(1), "files") + 0.2 * F.coalesce("most_tag", F.lit(0)) / F.col("n") + 0.2 * F.col("c") / F.col("n")
    return F.when(F.col("n") <= 1, 1.0).otherwise(value)


def kind_of() -> Column:
    """The type of a cluster; a test, docs or config only if nothing is added or removed."""
    adds, removes, changes = any_of(ADDS), any_of(REMOVES), any_of(CHANGES)
    still = ~adds & ~removes
    return (
        F.when((count_of("tag", "test") > 0) & still, "test").when(F.col("doc") & still, "docs").when((count_of("tag", "config") > 0) & still, "config")
        .when(adds & removes, "refactor").when(adds & ~changes, "feature").when(changes & still, "bugfix").otherwise("mixed")
    )


def mixed() -> Column:
    """Three categories or more, or configuration and anything else, or little cohesion."""
    return (F.col("kinds") >= 3) | (any_of(CONFIG) & (sum_of(CONFIG) < F.col("n"))) | (F.col("cohesion") < COHESIVE)


def cohesion(signals: DataFrame) -> DataFrame:
    """cluster, n, cohesion: .3 largest category share + .3 / files + .2 largest tag share + .2 mean confidence; 1 for a single signal."""
    return clusters(signals).select("cluster", "n", F.round(cohesion_of(), 6).alias("cohesion"))


def cluster_types(signals: DataFrame) -> DataFrame:
    """cluster, kind, mixed."""
    return clusters(signals).withColumn("cohesion", cohesion_of()).select("cluster", kind_of().alias("kind"), mixed().alias("mixed"))


def meets(conditions: list) -> Column:
    compare = {"eq": Column.__eq__, "gt": Column.__gt__, "lt": Column.__lt__, "gte": Column.__ge__, "lte": Column.__le__}
    met = F.lit(True)
    for c in conditions:
        if isinstance(c, tuple):
            met = met & compare[c[1]](count_of("category", c[0]), F.lit(c[2]))
        elif c.startswith("#"):
            met = met & (count_of("tag", c[1:]) > 0)
        elif c.startswith("@"):
            met = met & (F.col("kind") == c[1:])
        else:
            met = met & (count_of("category", c) > 0)
    return met


def matched(signals: DataFrame) -> DataFrame:
    """The clusters with matches: (base, priority, template) of every template all of whose conditions they meet, the best first."""
    rows = clusters(signals).withColumns({"kind": kind_of(), "cohesion": cohesion_of()}).withColumn("mixed", mixed())
    every = F.array(*(F.when(meets(c), F.struct((-F.lit(base)).alias("minus"), F.lit(-priority).alias("back"), F.lit(name).alias("template"))) for name, priority, base, c in TEMPLATES))
    return rows.withColumn("matches", F.array_sort(F.array_compact(every)))


def template_matches(signals: DataFrame) -> DataFrame:
    """cluster, template, base, priority, n_matches: the template with the largest confidence, then priority, then by name; all others are alternatives."""
    best = F.col("matches")[0]
    return matched(signals).select("cluster", best["template"].alias("template"), (-best["minus"]).alias("base"), (-best["back"]).alias("priority"), F.size("matches").alias("n_matches"))


def worth() -> Column:
    """Base x cohesion x mean confidence, with boosts for evidence and penalties for noise; of the columns of ``matched``."""
    # Every boost is above 1 and the product is cut at 1, so their order does not matter.
    boosts = reduce(lambda a, b: a * b, (F.pow(F.lit(f), sum(count_of("category", c) for c in kinds)) for f, kinds in BOOSTS))
    valued = reduce(lambda a, b: a + b, (count_of("category", c) for _, kinds in BOOSTS for c in kinds)) > 0
    start = -F.col("matches")[0]["minus"] * F.col("cohesion") * F.col("c") / F.col("n")
    value = F.least(F.lit(1.0), start * boosts * F.exp("log")) * F.when(valued, 1.0).otherwise(0.95)
    value = value * F.when(F.col("n") > 5, F.greatest(F.lit(0.5), 1 - (F.col("n") - 5) * 0.04)).otherwise(1.0) * F.when(F.col("mixed"), 0.85).otherwise(1.0)
    value = value * F.when(F.col("cohesion") < COHESIVE, 0.7 + 0.3 * F.col("cohesion") / COHESIVE).otherwise(1.0)
    value = value * F.when(F.col("kinds") > 4, 0.9).otherwise(1.0) * F.when(F.col("files") > 5, 0.92).otherwise(1.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)) + 1e-9, 5)  # half a digit rounds up, whatever the order of the factors


def confidence(signals: DataFrame) -> DataFrame:
    """cluster, template, confidence, band."""
    value = worth()
    return matched(signals).select("cluster", F.col("matches")[0]["template"].alias("template"), value.alias("confidence"), F.when(value >= 0.8, "high").when(value >= 0.5, "medium").otherwise("low").alias("band"))
