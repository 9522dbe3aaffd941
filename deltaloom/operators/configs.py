"""Differences of JSON documents: paths of changed, added and removed values, dependencies of packages, meanings of keys.

Rows have before and after, two JSON texts, and key columns that no other row has. What one side lacks is reported at its topmost
path. Arrays are opaque: any difference within one is a change of the outermost array. Numbers are equal by value as doubles (1 and 1.0);
null is a value of its own type. A row with a null or malformed text on either side has no changes; invalid lists such rows.

Each row is walked where it is, nothing is shuffled; a text that rows in turn have after and before is parsed once. What counts as JSON is what
Spark's parser takes: texts that another one might read otherwise (scalars, repeated keys, very long or deep ones, halves of surrogate
pairs, and all that are malformed) are walked as VARIANT pairs, level by level and all at once, of which a level only explodes the keys of objects.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from deltaloom.sources.tables import settled

#: Sections of a package's dependencies.
SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
#: What a key means by the first list that has a part of it, in this order.
MEANINGS = (
    ("feature_flag", ("enabled", "disabled", "feature", "flag", "toggle"), "FEATURE_FLAG_CHANGED"),
    ("timeout", ("timeout", "ttl", "expire", "duration"), "TIMEOUT_CHANGED"),
    ("limit", ("limit", "max", "min", "threshold", "size", "count"), "LIMIT_CHANGED"),
    ("retry", ("retry", "attempt", "backoff"), "RETRY_CONFIG_CHANGED"),
    ("endpoint", ("url", "host", "port", "endpoint"), "ENDPOINT_CHANGED"),
    ("credential", ("secret", "key", "token", "password", "credential"), "CREDENTIAL_CHANGED"),
)


def kind(v: Column) -> Column:
    """object, array, string, number, boolean or null of a VARIANT; null where there is no value at all."""
    name = F.schema_of_variant(v)
    simple = F.when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").otherwise("number")
    return F.when(v.isNotNull(), F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").otherwise(simple))


def parsed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, F.try_parse_json("before").alias("b"), F.try_parse_json("after").alias("a"))


def invalid(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of rows whose texts are null or no JSON."""
    return parsed(rows, keys).where("b IS NULL OR a IS NULL").select(*keys)


#: Characters of a text and brackets in it from which on it is walked as VARIANT; characters of texts, and paths, that a task keeps.
LONG, DEEP, KEPT, PATHS = 50_000, 200, 1 << 21, 50_000
#: What another parser than Spark's might read otherwise: halves of surrogate pairs, very long numbers.
DOUBTFUL = re.compile(r"\\u[dD][89a-fA-F]|[0-9]{200}")
#: What stands for values whose equality in Python is not that of JSON, and for a value that is not there.
OBJECT, TRUE, FALSE, GONE = (type(name, (), {})() for name in ("Object", "True_", "False_", "Gone"))
CATEGORIES = ("JSON_FIELD_ADDED", "JSON_FIELD_REMOVED", "JSON_VALUE_CHANGED", "JSON_ARRAY_CHANGED", "DEPENDENCY_ADDED", "DEPENDENCY_REMOVED", "DEPENDENCY_UPDATED")
ADDED, REMOVED, VALUE, ARRAY, DEPENDENCY = range(5)


def no_repeats(pairs: list[tuple]) -> dict:
    if len(found := dict(pairs)) < len(pairs):
        raise ValueError("a key is there twice")
    return found


def no_constant(name: str):
    raise ValueError(name)


#: All numbers are doubles.
READ = json.JSONDecoder(object_pairs_hook=no_repeats, parse_int=float, parse_constant=no_constant).decode


def frozen(value):
    """A value that is equal to another one if they are the same JSON: arrays are tuples, objects within them sets of their fields."""
    kind = type(value)
    if kind is list:
        return tuple(map(frozen, value))
    if kind is dict:
        return frozenset((k, frozen(v)) for k, v in value.items())
    return (TRUE if value else FALSE) if kind is bool else value


class Documents(dict):
    """By the bytes of a text its values by the numbers of their places, OBJECT for objects; None for a text that Spark is to read. Place 0 is the whole document."""

    def __init__(self):
        self.places, self.parents, self.names, self.sections, self.room, self.twice = {}, [-1], [""], set(), KEPT, False
        self.known = {""}

    def full(self) -> bool:
        return self.room < 0 or len(self.names) > PATHS

    def place(self, parent: int, key: str) -> int:
        if (found := self.places.get((parent, key))) is None:
            found = self.places[parent, key] = len(self.names)
            name = f"{self.names[parent]}.{key}" if self.names[parent] else key
            self.twice |= name in self.known  # by keys with dots
            self.known.add(name)
            self.names.append(name)
            self.parents.append(parent)
            if parent == 0 and key in SECTIONS:
                self.sections.add(found)
        return found

    def __missing__(self, data: bytes) -> dict | None:
        value = flat = None
        self.room -= len(data)
        try:
            text = data.decode()
            if len(text) < LONG and text.count("{") + text.count("[") < DEEP and not DOUBTFUL.search(text):
                value = READ(text)
        except ValueError:
            pass
        if type(value) is list:
            flat = {0: frozen(value)}
        elif type(value) is dict:
            flat, todo = {0: OBJECT}, [(0, value)]
            for parent, fields in todo:
                for key, v in fields.items():
                    at = self.place(parent, key)
                    if type(v) is dict:
                        flat[at] = OBJECT
                        todo.append((at, v))
                    else:
                        flat[at] = frozen(v)
        self[data] = flat
        return flat

    def changes(self, b: dict, a: dict) -> list[int]:
        """8 * place + number of the category for what differs between two documents; a (path, category) is there once."""
        found, parents, gone = [], self.parents, 0
        for at, v in b.items():
            w = a.get(at, GONE)
            if w is v or w == v:
                continue
            if w is GONE:
                gone += 1
                if a.get(parents[at]) is OBJECT:
                    found.append(at * 8 + REMOVED)
            else:
                found.append(at * 8 + (ARRAY if type(v) is tuple and type(w) is tuple else VALUE))
        if len(a) + gone > len(b):
            found += [at * 8 + ADDED for at in a.keys() - b.keys() if b.get(parents[at]) is OBJECT]
        return list({(self.names[x >> 3], x & 7): x for x in found}.values()) if self.twice else found

    def of_package(self, b: dict, a: dict) -> list[int]:
        """The same with the dependencies and only those other changes that are neither one of them, nor below one, nor above one."""
        found, parents, sections = [], self.parents, self.sections
        for at in b.keys() | a.keys():
            if parents[at] in sections:
                old, new = (v if type(v := x.get(at)) is str else None for x in (b, a))
                if old != new:
                    found.append(at * 8 + DEPENDENCY + (0 if old is None else 1 if new is None else 2))
        known = {self.names[x >> 3] for x in found}
        above = set().union(*map(upto, known))
        return found + [x for x in self.changes(b, a) if (name := self.names[x >> 3]) not in above and known.isdisjoint(upto(name))]


@lru_cache(maxsize=10_000)
def upto(path: str) -> list[str]:
    """The path and every shorter one that ends before a dot."""
    return [path[: m.start()] for m in re.finditer(r"\.|$", path)]


def walked(rows: DataFrame, keys: list[str], changes: Callable) -> tuple[DataFrame, DataFrame]:
    """keys, path, category of the rows whose texts are surely read as Spark reads them; the other rows. changes: of Documents."""
    kept = StructType([*(rows.schema[k] for k in keys), StructField("changes", ArrayType(StringType())), StructField("before", StringType()), StructField("after", StringType())])

    def out(batch: pa.RecordBatch, begin: int, numbers: list[int], found: list[int], names: list[str]) -> pa.RecordBatch:
        """The rows from begin on with the changes found, so many of each: the number of the category, and the path."""
        numbers = np.array(numbers, np.int64)
        each, which = np.unique(np.array(found, np.int64), return_inverse=True)
        each = pa.array([f"{x & 7}{names[x >> 3]}".encode("utf-8", "replace") for x in each.tolist()], pa.binary()).cast(pa.string())
        at = np.flatnonzero(numbers)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(numbers[at])], pa.int32()), each.take(pa.array(which)))
        nothing = pa.nulls(len(at), pa.string())
        return pa.RecordBatch.from_arrays([*batch.select(keys).take(pa.array(begin + at)).columns, lists, nothing, nothing], names=kept.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = Documents()
        for batch in batches:
            begin, numbers, found, left = 0, [], [], []
            for i, (before, after) in enumerate(zip(*(batch.column(c).cast(pa.binary()).to_pylist() for c in ("before", "after")), strict=True)):
                if documents.full():
                    yield out(batch, begin, numbers, found, documents.names)
                    begin, numbers, found, documents = i, [], [], Documents()
                own = ()
                if before is not None and after is not None:
                    b, a = documents[before], documents[after]
                    if b is None or a is None:
                        left.append(i)
                    else:
                        own = changes(documents, b, a)
                numbers.append(len(own))
                found += own
            yield out(batch, begin, numbers, found, documents.names)
            if left:
                rest = batch.take(pa.array(left, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(rest.column(k) for k in keys), pa.nulls(len(left), pa.list_(pa.string())), rest.column("before"), rest.column("after")], names=kept.names)

    every = settled(rows.select(*keys, "before", "after").mapInArrow(run, kept))
    found = every.where("changes IS NOT NULL").select(*keys, F.explode("changes").alias("change"))
    category = F.get(F.array(*map(F.lit, CATEGORIES)), F.substring("change", 1, 1).cast("int"))
    return found.select(*keys, F.expr("substring(change, 2)").alias("path"), category.alias("category")), every.where("before IS NOT NULL").select(*keys, "before", "after")


def json_changes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, category: JSON_FIELD_ADDED, JSON_FIELD_REMOVED, JSON_VALUE_CHANGED or JSON_ARRAY_CHANGED; the path of the whole document is empty."""
    found, left = walked(rows, keys, Documents.changes)
    return found if left.isEmpty() else found.unionByName(by_levels(left, keys))


def package_changes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, category: merged_changes of the dependencies and the other changes of the rows."""
    found, left = walked(rows, keys, Documents.of_package)
    return found if left.isEmpty() else found.unionByName(merged_changes(dependency_changes(left, keys), by_levels(left, keys), keys))


def by_levels(rows: DataFrame, keys: list[str]) -> DataFrame:
    """json_changes of any texts, walked as VARIANT pairs."""
    level = parsed(rows, keys).where("b IS NOT NULL AND a IS NOT NULL").select(*keys, F.lit("").alias("path"), F.lit(False).alias("inside"), "b", "a")
    found = []
    while True:
        text = lambda c: F.to_json(F.col(c))
        both = level.select("*", kind(F.col("b")).alias("kb"), kind(F.col("a")).alias("ka"), text("b").alias("tb"), text("a").alias("ta")).where("kb IS NULL OR ka IS NULL OR tb <> ta")
        number = F.col("b").try_cast("double") != F.col("a").try_cast("double")
        deeper = F.coalesce((F.col("kb") == F.col("ka")) & F.col("kb").isin("object", "array"), F.lit(False))
        change = F.when(F.col("kb").isNull(), "JSON_FIELD_ADDED").when(F.col("ka").isNull(), "JSON_FIELD_REMOVED").when((F.col("kb") != F.col("ka")) | (F.col("kb") != "number") | number, "JSON_VALUE_CHANGED")
        both = settled(both.select(*keys, "path", "inside", "b", "a", deeper.alias("deeper"), F.col("kb").alias("kind"), F.when(~deeper, F.when(F.col("inside") & change.isNotNull(), "JSON_ARRAY_CHANGED").otherwise(change)).alias("category")))
        found.append(both.where("category IS NOT NULL").select(*keys, "path", "category"))
        open_ = both.where("deeper")
        if open_.isEmpty():
            break
        names = lambda c: F.map_keys(F.col(c).cast("map<string,variant>"))
        fields = open_.where("kind = 'object'").select(*keys, "path", "inside", F.col("b").cast("map<string,variant>").alias("mb"), F.col("a").cast("map<string,variant>").alias("ma"), F.explode(F.array_union(names("b"), names("a"))).alias("key"))
        own = F.when(F.col("inside"), F.col("path")).when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws(".", "path", "key"))
        fields = fields.select(*keys, own.alias("path"), "inside", F.try_element_at("mb", "key").alias("b"), F.try_element_at("ma", "key").alias("a"))
        items = open_.where("kind = 'array'").select(*keys, "path", F.lit(True).alias("inside"), F.explode(F.arrays_zip(F.col("b").cast("array<variant>").alias("b"), F.col("a").cast("array<variant>").alias("a"))).alias("x"))
        level = fields.unionByName(items.select(*keys, "path", "inside", "x.b", "x.a"))
    return reduce(DataFrame.unionByName, found).distinct()


def major(version: Column) -> Column:
    """What stands before the first dot, without marks of a range."""
    return F.substring_index(F.regexp_replace(version, "^[\\^~>=<]+", ""), ".", 1)


def dependency_changes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path (section.name), category, old, new, tags of dependencies that come, go or change; versions that are no strings do not count."""
    texts = lambda v, s: F.coalesce(F.map_filter(F.when(kind(F.try_variant_get(v, f"$.{s}", "variant")) == "object", F.try_variant_get(v, f"$.{s}", "variant").cast("map<string,variant>")), lambda _, x: kind(x) == "string"), F.create_map().cast("map<string,variant>"))
    whole = parsed(rows, keys).where("b IS NOT NULL AND a IS NOT NULL")
    each = whole.select(*keys, F.explode(F.array(*(F.struct(F.lit(s).alias("section"), texts("b", s).alias("b"), texts("a", s).alias("a")) for s in SECTIONS))).alias("x"))
    named = each.select(*keys, "x.section", "x.b", "x.a", F.explode(F.array_union(F.map_keys("x.b"), F.map_keys("x.a"))).alias("name"))
    value = lambda c: F.try_element_at(c, F.col("name")).cast("string")
    named = named.select(*keys, F.concat_ws(".", "section", "name").alias("path"), value("b").alias("old"), value("a").alias("new")).where(~F.col("old").eqNullSafe(F.col("new")))
    category = F.when(F.col("old").isNull(), "DEPENDENCY_ADDED").when(F.col("new").isNull(), "DEPENDENCY_REMOVED").otherwise("DEPENDENCY_UPDATED")
    other_major = (major(F.col("old")) != "") & (major(F.col("new")) != "") & (major(F.col("old")) != major(F.col("new")))
    tags = F.when(F.col("new").isNull() | (F.col("old").isNotNull() & other_major), F.array(F.lit("config"), F.lit("breaking"))).otherwise(F.array(F.lit("config")))
    return named.select(*keys, "path", category.alias("category"), "old", "new", tags.alias("tags"))


def beginnings(path: Column) -> Column:
    """The path and every shorter one that ends before a dot."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def merged_changes(dependencies: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, category: the dependencies, and the changes that are neither one of them, nor below one, nor above one."""
    known = dependencies.select(*keys, "path")
    above = known.select(*keys, F.explode(beginnings(F.col("path"))).alias("path")).distinct()
    left = changes.join(above, [*keys, "path"], "left_anti").withColumn("up", F.explode(beginnings(F.col("path"))))
    covered = left.join(known.withColumnRenamed("path", "up"), [*keys, "up"], "left_semi").select(*keys, "path").distinct()
    rest = changes.join(above, [*keys, "path"], "left_anti").join(covered, [*keys, "path"], "left_anti")
    return dependencies.select(*keys, "path", "category").unionByName(rest.select(*keys, "path", "category"))


def enriched(changes: DataFrame) -> DataFrame:
    """The changes with key_category; a changed value of a known meaning takes the category of that meaning."""
    meaning = category = None
    changes = changes.withColumn("lower path", F.lower("path"))  # once for all words
    for name, parts, becomes in MEANINGS:
        hit = reduce(lambda a, b: a | b, (F.contains("lower path", F.lit(p)) for p in parts))
        meaning = F.when(hit, name) if meaning is None else meaning.when(hit, name)
        hit = F.col("key_category") == name
        category = F.when(hit, becomes) if category is None else category.when(hit, becomes)
    changes = changes.withColumn("key_category", meaning.otherwise("general")).drop("lower path")
    changed = F.col("category").isin("JSON_VALUE_CHANGED", "YAML_VALUE_CHANGED")
    return changes.withColumn("category", F.when(changed, F.coalesce(category, F.col("category"))).otherwise(F.col("category")))
