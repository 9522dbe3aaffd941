"""What a change is for, in words: variables of clusters, sentences of templates, summaries of mixed clusters, warnings, plain sentences, scores against expected ones.

Signals are those of ``signals`` with evidence: seq (of any type that has an order; that of a cluster's signals), symbols (array of strings), old_name, new_name, after_value, path, module.
Nulls are values that are not there. Where two signals of a cluster have the same seq, the smaller value counts. Whole clusters never meet in one array: what is first comes from
aggregations that map tasks begin, names are counted before the first three are taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaloom.operators import records, signals

#: What the templates say.
PATTERNS = {
    "rename_function": "Rename {oldName} to {newName} in {module}",
    "add_single_function": "Add {functionName} in {module}",
    "remove_single_function": "Remove {functionName} from {module}",
    "add_multiple_functions": "Add {functions} in {module}",
    "refactor_functions": "Refactor {functions} in {module}",
    "update_api_parameters": "Update {functionName} parameters in {module}",
    "update_api_parameters_removed": "Update {functionName} parameters in {module}",
    "update_api_surface": "Update API in {module}",
    "add_dependency": "Add {dependencyName} dependency",
    "remove_dependency": "Remove {dependencyName} dependency",
    "update_dependency": "Update {dependencyName} to {version}",
    "update_dependencies": "Update dependencies in {module}",
    "modify_function": "Modify {functionName} in {module}",
    "update_imports": "Update imports in {module}",
    "modify_condition": "Modify condition in {area}",
    "update_constant": "Update constant in {area}",
    "add_file": "Add {fileName}",
    "remove_file": "Remove {fileName}",
    "update_json_config": "Update {configField} in {fileName}",
    "update_yaml_config": "Update {configField} in {fileName}",
    "update_tests": "Update tests for {area}",
    "update_config": "Update configuration in {module}",
    "toggle_feature_flag": "Toggle {configField} feature flag in {module}",
    "update_timeout": "Update {configField} timeout in {module}",
    "update_limit": "Update {configField} limit in {module}",
    "update_retry_config": "Update retry configuration in {module}",
    "update_endpoint": "Update {configField} endpoint in {module}",
    "update_credential": "Update {configField} credential in {module}",
    "add_schema_field": "Add {schemaField} to {schemaEntity}",
    "remove_schema_field": "Remove {schemaField} from {schemaEntity}",
    "update_schema_field": "Update {schemaField} in {schemaEntity}",
    "add_migration": "Add database migration for {migrationName}",
    "update_auth_flow": "Update authentication flow in {module}",
    "update_permissions": "Update permission checks in {module}",
    "update_file": "Update {area} in {module}",
    "generic_update": "Update {area} in {module}",
}
#: The words that settings of a category end with.
KEYWORDS = {"TIMEOUT_CHANGED": "timeout", "LIMIT_CHANGED": "limit", "RETRY_CONFIG_CHANGED": "retry", "ENDPOINT_CHANGED": "endpoint", "CREDENTIAL_CHANGED": "credential", "FEATURE_FLAG_CHANGED": "flag"}
#: What groups of a category are called, for one and for more.
GROUPS = {
    "FUNCTION_ADDED": ("function added", "functions added"), "FUNCTION_REMOVED": ("function removed", "functions removed"), "FUNCTION_RENAMED": ("function renamed", "functions renamed"),
    "FUNCTION_BODY_CHANGED": ("function modified", "functions modified"), "JSON_VALUE_CHANGED": ("config value changed", "config values changed"), "YAML_VALUE_CHANGED": ("config value changed", "config values changed"),
    **dict.fromkeys(signals.DEPENDENCIES, ("dependency change", "dependency changes")), **dict.fromkeys(("SCHEMA_FIELD_ADDED", "SCHEMA_FIELD_REMOVED", "SCHEMA_FIELD_CHANGED"), ("schema change", "schema changes")),
}
#: Categories whose first symbol is the name of a setting.
SETTINGS = ("JSON_VALUE_CHANGED", "YAML_VALUE_CHANGED", "JSON_FIELD_ADDED", "JSON_FIELD_REMOVED")
#: Signals above which a cluster is large; similarity from which a sentence is partly right; least confidence of a right one.
LARGE, PARTLY, SURE = 8, 0.7, 0.5


def filled(value: Column) -> Column:
    """The text, null where it is empty."""
    return F.when(value != "", value)


def first(where: Column, **values: Column) -> Column:
    """A struct of the values at the first signal that meets a condition; null where none does."""
    return F.min(F.when(where, F.struct("seq", *(v.alias(k) for k, v in values.items()))))


def first_names(rows: DataFrame) -> DataFrame:
    """cluster, names: the first three different names (symbols name:…) of each cluster, in order."""
    each = rows.select("cluster", "seq", F.posexplode_outer("symbols").alias("pos", "symbol")).where("symbol LIKE 'name:%'")  # outer: else a filter would go below the shuffle of the rows and make it another one
    once = each.groupBy("cluster", F.substring("symbol", 6, 1 << 30).alias("name")).agg(F.min(F.struct("seq", "pos")).alias("at"))
    early = once.withColumn("nth", F.row_number().over(W.partitionBy("cluster").orderBy("at", "name"))).where("nth <= 3")  # a limit for each group, applied before the shuffle too
    return early.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "name"))), lambda x: x["name"]).alias("names"))


def listed(names: Column) -> Column:
    """One name, "a and b", or "a, b and others"; null for none."""
    return F.when(F.size(names) == 1, names[0]).when(F.size(names) == 2, F.array_join(names, " and ")).when(F.size(names) > 2, F.concat(F.array_join(F.slice(names, 1, 2), ", "), F.lit(" and others")))


def conjoined(items: Column) -> Column:
    """"a", "a and b", "a, b, and c"."""
    last = F.element_at(items, -1)
    return F.when(F.size(items) <= 2, F.array_join(items, " and ")).otherwise(F.concat(F.array_join(F.slice(items, 1, F.size(items) - 1), ", "), F.lit(", and "), last))


def setting_name(path: Column, category: Column) -> Column:
    """The last part of a dotted path; where that is the category's own word, what is around it: the two parts before it, or the one."""
    parts = F.split(path, r"\.")
    own = F.lower(F.element_at(parts, -1)) == F.element_at(F.create_map(*(F.lit(x) for kv in KEYWORDS.items() for x in kv)), category)
    before = F.when(F.size(parts) >= 3, F.concat_ws(" ", F.get(parts, F.size(parts) - 3), F.get(parts, F.size(parts) - 2))).when(F.size(parts) == 2, parts[0])
    return F.coalesce(F.when(own, before), F.element_at(parts, -1))


def variables(rows: DataFrame) -> DataFrame:
    """One row for each cluster: module (of its first signal that has one, else General), function_name, functions, old_name and new_name (of the first rename), file_name (of the first file, without its
    ending), config_field (of the first semantic setting if it has a symbol, else of the first plain one with a symbol), dependency_name, version, schema_entity and schema_field or
    migration_name (whatever comes first). What is not there is null."""
    kind = F.col("category")
    head = filled(F.get("symbols", F.lit(0)))
    has = F.size("symbols") > 0
    schema = kind.isin("SCHEMA_FIELD_ADDED", "SCHEMA_FIELD_REMOVED", "SCHEMA_FIELD_CHANGED")
    found = rows.groupBy("cluster").agg(
        first(F.col("module").isNotNull(), v=F.col("module")).alias("mod"), first(kind == "FUNCTION_RENAMED", old=F.col("old_name"), new=F.col("new_name")).alias("renamed"),
        first(F.col("path").isNotNull(), v=F.col("path")).alias("file"), first(kind.isin(*SETTINGS) & has, v=head).alias("plain"), first(kind.isin(*KEYWORDS), kind=kind, v=head).alias("meant"),
        first(kind.isin(*signals.DEPENDENCIES), new=filled(F.col("new_name")), old=F.col("old_name"), to=F.col("after_value")).alias("dep"),
        first(schema | (kind == "MIGRATION_ADDED"), schema=schema, v=head).alias("shape"),
    )
    named = found.join(first_names(rows), "cluster", "left")
    shape = F.when(F.col("shape.schema"), F.regexp_replace("shape.v", "^[^:]+:", ""))
    dotted = shape.rlike(r"^[^.]+\.")
    return named.select(
        "cluster", F.coalesce("mod.v", F.lit("General")).alias("module"), F.get("names", F.lit(0)).alias("function_name"), listed(F.col("names")).alias("functions"),
        filled(F.col("renamed.old")).alias("old_name"), filled(F.col("renamed.new")).alias("new_name"), filled(F.regexp_replace(F.regexp_extract("file.v", "[^/]*$", 0), r"\.[^.]*$", "")).alias("file_name"),
        F.coalesce(setting_name(F.col("meant.v"), F.col("meant.kind")), F.col("plain.v")).alias("config_field"),
        F.coalesce("dep.new", filled(F.col("dep.old"))).alias("dependency_name"), filled(F.col("dep.to")).alias("version"),
        filled(F.when(dotted, F.regexp_extract(shape, r"^([^.]+)\.", 1)).otherwise(shape)).alias("schema_entity"), filled(F.when(dotted, F.regexp_replace(shape, r"^[^.]+\.", ""))).alias("schema_field"),
        F.when(~F.col("shape.schema"), F.col("shape.v")).alias("migration_name"),
    )


#: The places of a pattern and the columns that fill them.
PLACES = {
    "module": "module", "area": "area", "functionName": "function_name", "functions": "functions", "oldName": "old_name", "newName": "new_name", "fileName": "file_name", "configField": "config_field",
    "dependencyName": "dependency_name", "version": "version", "schemaField": "schema_field", "schemaEntity": "schema_entity", "migrationName": "migration_name",
}


def rendered(pattern: Column) -> Column:
    """The pattern with its places filled from the columns of the row; places without a value go, and so do spaces that then stand double."""
    text = reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), F.coalesce(F.col(kv[1]), F.lit(""))), PLACES.items(), pattern)
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\{[^}]+\}", ""), r"(?U)\s+", " "))


def areas(rows: DataFrame) -> DataFrame:
    """cluster, area: as ``records.primary_areas`` has it, over all names of the signals and all files."""
    name = F.explode_outer(F.filter("symbols", lambda s: s.startswith("name:")))
    return records.primary_areas(rows.select("cluster", name.alias("symbol"), "path").withColumn("symbol", F.substring("symbol", 6, 1 << 30)))


def sub_intents() -> Column:
    """What the groups of a mixed or large cluster are called, by category; of the columns of ``signals.matched``. Twelve at most."""
    number = lambda c: signals.count_of("category", c)
    each = (F.when(number(c) > 0, F.concat(number(c).cast("string"), F.lit(" "), F.when(number(c) == 1, one).otherwise(more))) for c, (one, more) in sorted(GROUPS.items()))
    return F.when(F.col("mixed") | (F.col("n") > LARGE), F.array_compact(F.array(*each))).otherwise(F.array().cast("array<string>"))


def facts(rows: DataFrame) -> DataFrame:
    """One row for each cluster, all from one count of its signals: its sentence (see primary), and n, mixed, subs, minus (cohesion times total weight, below zero), breaking, secret and loss (see warnings)."""
    subs = F.col("subs")
    shown = F.when(F.size(subs) > 3, F.concat(conjoined(F.slice(subs, 1, 3)), F.lit(" and "), (F.size(subs) - 3).cast("string"), F.lit(" more"))).otherwise(conjoined(subs))
    worth = F.lit(0.55) + F.when(F.col("c") / F.col("n") >= 0.8, 0.1).otherwise(0.0) + F.when(signals.any_of(signals.HIGH), 0.05).otherwise(0.0) - F.when(F.col("n") > LARGE, 0.05).otherwise(0.0)
    known = [signals.count_of("category", c) * w for c, w in signals.WEIGHTS.items()]
    others = F.col("n") - reduce(lambda a, b: a + b, (signals.count_of("category", c) for c in signals.WEIGHTS))
    score = F.round(F.col("cohesion") * (reduce(lambda a, b: a + b, known) + 0.1 * others), 6)
    counted = signals.matched(rows).withColumn("subs", sub_intents()).select(
        "cluster", "n", "mixed", subs, shown.alias("summary"), F.round(F.greatest(F.lit(0.45), F.least(F.lit(0.75), worth)), 6).alias("worth"), F.size("matches").alias("n_matches"),
        F.col("matches")[0]["template"].alias("template"), signals.worth().alias("confidence"), (-score).alias("minus"), (signals.count_of("tag", "breaking") > 0).alias("breaking"),
        (signals.count_of("category", "CREDENTIAL_CHANGED") > 0).alias("secret"), (signals.count_of("category", "SCHEMA_FIELD_REMOVED") > 0).alias("loss"),
    )
    every = counted.join(variables(rows), "cluster").join(areas(rows), "cluster")
    able = F.col("mixed") & (F.size(subs) > 0)
    best = F.when(able, F.greatest("confidence", "worth")).otherwise(F.col("confidence"))
    generic = (F.col("template") == "generic_update") & (F.col("confidence") >= F.col("worth"))
    taken = able & ((F.size(subs) > 1) | (best < 0.6) | generic | (F.col("worth") > F.col("confidence")))
    said = rendered(F.element_at(F.create_map(*(F.lit(x) for kv in PATTERNS.items() for x in kv)), F.col("template")))
    return every.select(
        "cluster", F.when(taken, F.concat(F.lit("Mixed changes in "), F.col("module"), F.lit(": "), F.col("summary"))).otherwise(said).alias("text"),
        F.when(taken, "mixed_summary").otherwise(F.col("template")).alias("template"), F.when(taken, F.col("worth")).otherwise(F.col("confidence")).alias("confidence"),
        (F.col("n_matches") - 1 + able.cast("int")).alias("n_alternatives"), "n", "mixed", "subs", "minus", "breaking", "secret", "loss",
    )


def primary(rows: DataFrame) -> DataFrame:
    """cluster, text, template, confidence, n_alternatives: the sentence of each cluster.

    It is that of the best template; a summary of the groups takes its place in a mixed cluster with several groups, or with one where the best is unsure (below 0.6) or
    generic, and wherever its own confidence is larger. The alternatives are the candidates after the first: a template that a summary displaces is not among them.
    """
    return facts(rows).select("cluster", "text", "template", "confidence", "n_alternatives")


def warnings(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """change, cluster, warnings for changes (change, cluster; a cluster in one change): the change's first cluster, by cohesion times total weight, then by its name, and what a reader should be warned of, in order."""
    return warned(facts(rows).join(changes, "cluster"))


def warned(every: DataFrame) -> DataFrame:
    """The same of facts with their change."""
    whole = every.groupBy("change").agg(
        F.min(F.struct("minus", "cluster", "mixed", "subs", "confidence")).alias("top"), F.count("*").alias("clusters"), F.sum("n").alias("n"), F.bool_or("breaking").alias("breaking"), F.bool_or("secret").alias("secret"), F.bool_or("loss").alias("loss")
    )
    lines = [
        (F.col("top.confidence") < SURE, "Low confidence intent - consider reviewing manually"), (F.col("clusters") > 3, "Many unrelated changes detected - consider splitting into multiple commits"),
        (F.col("top.mixed"), "Mixed changes detected - intent may not fully capture all changes"), None, (F.col("n") > LARGE, "Large changeset - consider smaller, focused commits"),
        (F.col("breaking"), "Contains breaking changes"), (F.col("secret"), "Contains credential/secret changes - review carefully"), (F.col("loss"), "Contains schema field removal - may require data migration"),
    ]
    groups = F.when(F.col("top.mixed"), F.transform("top.subs", lambda s: F.concat(F.lit("  - "), s))).otherwise(F.array().cast("array<string>"))
    of = lambda some: F.array_compact(F.array(*(F.when(c, F.lit(text)) for c, text in some)))
    return whole.select("change", F.col("top.cluster").alias("cluster"), F.concat(of(lines[:3]), groups, of(lines[4:])).alias("warnings"))


def plain_sentences(rows: DataFrame) -> DataFrame:
    """cluster, verb, text: the older, shorter sentence. A file that is added or deleted decides the verb, the first that does; then functions, the API, conditions, constants, JSON and contents.
    The object is the functions that came or went, else the module and the last part of the first symbol's name (column fq_name, if there is one), else the files' name or common folder."""
    kind = F.col("category")
    has = lambda *kinds: F.bool_or(kind.isin(*kinds))
    fq = filled(F.col("fq_name")) if "fq_name" in rows.columns else F.lit(None).cast("string")
    moved = kind.isin("FUNCTION_ADDED", "FUNCTION_REMOVED")
    facts = rows.groupBy("cluster").agg(
        first(kind.isin("FILE_ADDED", "FILE_DELETED"), kind=kind)["kind"].alias("opener"), has("FUNCTION_ADDED").alias("added"), has("FUNCTION_REMOVED").alias("removed"), has("API_SURFACE_CHANGED").alias("api"),
        has("CONDITION_CHANGED").alias("condition"), has("CONSTANT_UPDATED").alias("constant"), has("JSON_FIELD_ADDED", "JSON_FIELD_REMOVED").alias("field"), has("JSON_VALUE_CHANGED", "JSON_ARRAY_CHANGED").alias("value"),
        has("FILE_CONTENT_CHANGED").alias("content"), first(F.col("module").isNotNull(), v=F.col("module"))["v"].alias("module"), first(fq.isNotNull(), v=fq)["v"].alias("fq"),
    )
    steps = [
        (F.col("opener") == "FILE_ADDED", "Add"), (F.col("opener") == "FILE_DELETED", "Remove"), (F.col("added") & F.col("removed"), "Refactor"), (F.col("added"), "Add"), (F.col("removed"), "Remove"),
        (F.col("api"), "Update"), (F.col("condition"), "Modify"), (F.col("constant"), "Update"), (F.col("field"), "Update"), (F.col("value"), "Modify"), (F.col("content"), "Update"),
    ]
    verb = F.coalesce(*(F.when(c, F.lit(word)) for c, word in steps), F.lit("Change"))
    files = records.primary_areas(rows.select("cluster", F.lit(None).cast("string").alias("symbol"), "path"))
    every = facts.join(first_names(rows.where(moved)), "cluster", "left").join(files, "cluster").withColumns({"verb": verb, "module": F.coalesce("module", F.lit("General"))})
    area = F.coalesce(filled(F.regexp_extract("fq", r"[^.]*$", 0)), F.col("area"))
    text = F.when(F.size("names") > 0, F.concat_ws(" ", "verb", listed(F.col("names")), F.lit("in"), "module")).otherwise(F.concat_ws(" ", "verb", "module", area))
    return every.select("cluster", "verb", text.alias("text"))


def compared(text: Column) -> Column:
    """What of a sentence is compared: small letters, digits and single spaces; all else, letters beyond ASCII too, goes."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " ")), "[^a-z0-9 ]", "")


def scored(cases: DataFrame) -> DataFrame:
    """The cases with score, match and passed.

    cases: generated, confidence, template, breaking (there is a warning), expected, acceptable (array), expected_template, min_confidence, expected_breaking; null and 0 ask for the
    usual confidence, a null or empty template for none. match: exact 1, acceptable 0.95, partial or none by the share of common words; no sentence at all is none, 0. A case passes unless it matches in none, or
    confidence, template or warning are not as expected.
    """
    made, want = compared(F.col("generated")), compared(F.coalesce("expected", F.lit("")))
    words = lambda text: F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))
    a, b = words(made), words(want)
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    share = F.when(either == 0, 1.0).otherwise(both / F.greatest(either, F.lit(1)))
    alike = F.coalesce(F.exists("acceptable", lambda t: F.coalesce(compared(t) == made, F.lit(False))), F.lit(False))
    score = F.when(F.col("generated").isNull(), 0.0).when(made == want, 1.0).when(alike, 0.95).otherwise(share)
    match = F.when(F.col("generated").isNull(), "none").when(made == want, "exact").when(alike, "acceptable").when(share >= PARTLY, "partial").otherwise("none")
    least = F.when(F.coalesce("min_confidence", F.lit(0.0)) == 0, F.lit(SURE)).otherwise(F.col("min_confidence"))
    no = F.lit(False)
    sound = F.coalesce(F.col("confidence") >= least, no) & (F.coalesce(F.col("expected_template"), F.lit("")).isin("") | F.coalesce(F.col("template") == F.col("expected_template"), no))
    sound = sound & (F.coalesce("breaking", no) | ~F.coalesce("expected_breaking", no))
    return cases.withColumns({"score": score, "match": match}).withColumn("passed", sound & (F.col("match") != "none"))


def report(results: DataFrame) -> DataFrame:
    """level, name, total, passed, score, correct, used of scored cases with a category: over all of them (score: their mean), by category (score: share of passed cases; unknown where there is none)
    and by template (total: cases that expect it, correct: that got it, used: all that got it)."""
    at = lambda level, name, expected, used: F.struct(F.lit(level).alias("level"), name.alias("name"), expected.cast("long").alias("expected"), used.cast("long").alias("used"))
    wanted, got = filled(F.col("expected_template")), filled(F.col("template"))
    same = F.coalesce(wanted == got, F.lit(False))
    one, zero = F.lit(1), F.lit(0)
    places = F.array(
        at("all", F.lit(""), one, zero), at("category", F.coalesce(filled(F.col("category")), F.lit("unknown")), one, zero), F.when(wanted.isNotNull(), at("template", wanted, one, same.cast("int"))),
        F.when(got.isNotNull() & ~same, at("template", got, zero, one)),
    )
    each = results.select("passed", "score", F.explode(F.array_compact(places)).alias("at")).select("passed", "score", "at.*")
    whole = each.groupBy("level", "name").agg(
        F.sum("expected").alias("total"), F.sum(F.when(F.col("passed"), F.col("expected")).otherwise(0)).alias("passed"), F.avg("score").alias("mean"), F.sum("used").alias("used"),
        F.sum(F.col("expected") * F.col("used")).alias("correct"),
    )
    of_template = F.col("level") == "template"
    score = F.when(F.col("level") == "all", F.col("mean")).when(~of_template, F.col("passed") / F.col("total"))
    return whole.select("level", "name", "total", F.when(~of_template, F.col("passed")).alias("passed"), F.round(score, 6).alias("score"), F.when(of_template, F.col("correct")).alias("correct"), F.when(of_template, F.col("used")).alias("used"))
