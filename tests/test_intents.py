"""Sentences, warnings and scores of intents; purges and pushes: hand-made cases."""

from __future__ import annotations

import pytest

from deltaloom.operators import intents, purges
from deltaloom.plans import library
from deltaloom.sources import tables as src

SIGNAL = (
    "cluster long, seq long, category string, confidence decimal(6,2), tag string, path string, symbols array<string>, old_name string, new_name string, after_value string, module string, fq_name string"
)


@pytest.fixture
def told(spark):
    def rows(*given, **more):
        """Signals as (cluster, seq, category, symbols, and others by name)."""
        base = {"confidence": 0.9, "tag": "x", "path": "a/b.go", "old_name": None, "new_name": None, "after_value": None, "module": "Utils", "fq_name": None}
        names = [c.split()[0] for c in SIGNAL.split(", ")]
        out = []
        for cluster, seq, category, symbols, *rest in given:
            row = base | {"cluster": cluster, "seq": seq, "category": category, "symbols": symbols} | (rest[0] if rest else {})
            out.append(tuple(row[n] for n in names))
        from decimal import Decimal

        out = [tuple(Decimal(str(v)) if n == "confidence" else v for n, v in zip(names, r, strict=True)) for r in out]
        return spark.createDataFrame(out, SIGNAL)

    return rows


def by(df, key="cluster"):
    return {r[key]: r for r in df.collect()}


def test_rename_is_said(told):
    got = by(intents.primary(told((1, 1, "FUNCTION_RENAMED", ["name:b"], {"old_name": "a", "new_name": "b", "confidence": 0.95}))))[1]
    assert (got["text"], got["template"]) == ("Rename a to b in Utils", "rename_function")
    assert got["confidence"] >= 0.8


def test_names_and_first_values(told):
    rows = told(
        (1, 3, "FUNCTION_ADDED", ["name:late", "name:one"]), (1, 1, "FUNCTION_ADDED", ["other", "name:one"]), (1, 2, "FUNCTION_ADDED", ["name:two"]),
        (2, 2, "DEPENDENCY_UPDATED", [], {"new_name": "", "old_name": "lib", "after_value": "2.0", "module": None}), (2, 5, "DEPENDENCY_ADDED", [], {"new_name": "later", "after_value": "9", "module": None}),
        (3, 1, "JSON_VALUE_CHANGED", ["plain"]), (3, 2, "TIMEOUT_CHANGED", ["http.client.Timeout"]), (3, 3, "LIMIT_CHANGED", ["x.size"]),
        (4, 1, "MIGRATION_ADDED", ["init"]), (4, 2, "SCHEMA_FIELD_ADDED", ["table:users.email"]), (5, 1, "SCHEMA_FIELD_ADDED", ["table:users.email"]), (5, 2, "MIGRATION_ADDED", ["init"]),
        (6, 1, "SCHEMA_FIELD_REMOVED", ["model:User"]), (6, 2, "JSON_FIELD_ADDED", []), (6, 3, "YAML_VALUE_CHANGED", ["key"]), (7, 1, "CREDENTIAL_CHANGED", ["credential"]), (7, 2, "OTHER", ["name:"], {"path": None}),
    )
    got = by(intents.variables(rows))
    assert (got[1]["function_name"], got[1]["functions"]) == ("one", "one, two and others")
    assert (got[2]["module"], got[2]["dependency_name"], got[2]["version"]) == ("General", "lib", "2.0")
    assert got[3]["config_field"] == "http client"
    assert (got[4]["migration_name"], got[4]["schema_entity"]) == ("init", None)
    assert (got[5]["migration_name"], got[5]["schema_entity"], got[5]["schema_field"]) == (None, "users", "email")
    assert (got[6]["schema_entity"], got[6]["schema_field"], got[6]["config_field"]) == ("User", None, "key")
    assert (got[7]["config_field"], got[7]["file_name"]) == ("credential", "b")


def test_places_without_values_go(told):
    got = by(intents.primary(told((1, 1, "FUNCTION_ADDED", []), (2, 1, "FUNCTION_ADDED", ["name:{module}"]))))
    assert got[1]["text"] == "Add in Utils"
    assert got[2]["text"] == "Add in Utils"  # what a value brings in braces goes, too


def test_summary_of_a_mixed_cluster(told):
    mixed = [(1, i, c, [], {"path": f"p{i}/x.go", "module": "Auth"}) for i, c in enumerate(["FUNCTION_ADDED", "FUNCTION_REMOVED", "FUNCTION_REMOVED", "JSON_VALUE_CHANGED", "DEPENDENCY_ADDED"])]
    got = by(intents.primary(told(*mixed, (2, 1, "FUNCTION_BODY_CHANGED", ["name:f"]))))
    assert got[1]["text"] == "Mixed changes in Auth: 1 dependency change, 1 function added, and 2 functions removed and 1 more"
    assert (got[1]["template"], got[1]["confidence"]) == ("mixed_summary", 0.65)
    assert got[2]["text"] == "Modify f in Utils"


def test_warnings(spark, told):
    rows = told(
        (1, 1, "CREDENTIAL_CHANGED", ["a"], {"confidence": 1.0}), (2, 1, "SCHEMA_FIELD_REMOVED", ["table:t.c"], {"tag": "breaking"}), (3, 1, "OTHER", []), (4, 1, "OTHER", []), (5, 1, "FUNCTION_RENAMED", ["name:f"], {"old_name": "e", "new_name": "f"}),
        *((6, i, "OTHER", [], {"path": None, "tag": None, "confidence": 0.1}) for i in range(9)),
    )
    changes = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4), (2, 5), (3, 6)], "change long, cluster long")
    got = {r["change"]: (r["cluster"], r["warnings"]) for r in intents.warnings(rows, changes).collect()}
    assert got[1] == (1, ["Many unrelated changes detected - consider splitting into multiple commits", "Contains breaking changes", "Contains credential/secret changes - review carefully", "Contains schema field removal - may require data migration"])
    assert got[2] == (5, [])
    assert got[3] == (6, ["Low confidence intent - consider reviewing manually", "Large changeset - consider smaller, focused commits"])


@pytest.mark.parametrize(
    ("kinds", "verb"),
    [
        (["FUNCTION_ADDED", "FUNCTION_REMOVED"], "Refactor"), (["API_SURFACE_CHANGED", "FUNCTION_ADDED"], "Add"), (["FUNCTION_REMOVED", "FILE_ADDED", "FILE_DELETED"], "Add"), (["FILE_DELETED", "FILE_ADDED"], "Remove"),
        (["CONDITION_CHANGED", "CONSTANT_UPDATED"], "Modify"), (["JSON_ARRAY_CHANGED", "FILE_CONTENT_CHANGED"], "Modify"), (["JSON_FIELD_REMOVED"], "Update"), (["IMPORT_ADDED"], "Change"),
    ],
)
def test_verbs(told, kinds, verb):
    assert by(intents.plain_sentences(told(*((1, i, k, []) for i, k in enumerate(kinds)))))[1]["verb"] == verb


def test_plain_sentences(told):
    got = by(intents.plain_sentences(told(
        (1, 1, "FUNCTION_ADDED", ["name:f"]), (1, 2, "FUNCTION_REMOVED", ["name:g"]), (1, 3, "FUNCTION_BODY_CHANGED", ["name:h"]), (2, 1, "CONDITION_CHANGED", [], {"fq_name": "pkg.Type.run"}),
        (3, 1, "OTHER", [], {"path": "src/api/a.go"}), (3, 2, "OTHER", [], {"path": "src/api/b.go"}), (4, 1, "OTHER", [], {"path": None, "module": None}),
    )))
    assert [got[i]["text"] for i in (1, 2, 3, 4)] == ["Refactor f and g in Utils", "Modify Utils run", "Change Utils api", "Change General codebase"]


def test_empty_signals(spark):
    none = spark.createDataFrame([], SIGNAL)
    assert intents.primary(none).count() == intents.plain_sentences(none).count() == 0
    assert intents.warnings(none, spark.createDataFrame([], "change long, cluster long")).count() == 0


CASE = "generated string, confidence double, template string, breaking boolean, expected string, acceptable array<string>, expected_template string, min_confidence double, expected_breaking boolean, category string"


@pytest.mark.parametrize(
    ("case", "score", "match", "passed"),
    [
        (("Add  f in Utils.", 0.8, "t", False, "add f in utils", None, None, None, None), 1.0, "exact", True),
        (("Add f", 0.8, "t", False, "Create f", ["Make f", "add F!"], "t", 0.0, False), 0.95, "acceptable", True),
        (("a b c d", 0.8, "t", False, "a b c", [], "t", 0.9, False), 0.75, "partial", False),
        (("a b c d", 0.8, "t", False, "a b c", [], "t", 0.8, False), 0.75, "partial", True),
        (("a b", 0.8, "t", False, "a c", [], "", 0.0, False), 1 / 3, "none", False),
        (("a", 0.49, "t", False, "a", [], None, 0.0, False), 1.0, "exact", False),
        (("a", 0.8, "t", False, "a", [], "u", 0.0, False), 1.0, "exact", False),
        (("a", 0.8, "t", False, "a", [], "t", 0.0, True), 1.0, "exact", False),
        (("a", 0.8, "t", True, "a", [], "t", 0.0, True), 1.0, "exact", True),
        ((None, None, None, None, "", [], None, 0.0, False), 0.0, "none", False),
        (("!", 0.8, None, None, None, [None], "", None, None), 1.0, "exact", True),
        (("a", 0.8, None, None, "é", [], "t", None, None), 0.0, "none", False),
    ],
)
def test_scores(spark, case, score, match, passed):
    row = intents.scored(spark.createDataFrame([(*case, None)], CASE)).first()
    assert (row["score"], row["match"], row["passed"]) == (pytest.approx(score), match, passed)


def test_report(spark):
    rows = [("a", "t1", "t1", "x", True, 1.0), ("b", "t2", "t1", "x", False, 0.5), ("c", None, "t2", "", True, 0.75), ("d", "t3", None, None, False, 0.0)]
    got = {(r["level"], r["name"]): r for r in intents.report(spark.createDataFrame(rows, "id string, template string, expected_template string, category string, passed boolean, score double")).collect()}
    assert tuple(got["all", ""])[2:] == (4, 2, 0.5625, None, None)
    assert tuple(got["category", "x"])[2:5] == (2, 1, 0.5) and tuple(got["category", "unknown"])[2:5] == (2, 1, 0.5)
    assert {n: tuple(got["template", n])[2:] for n in ("t1", "t2", "t3")} == {"t1": (2, None, None, 1, 1), "t2": (1, None, None, 0, 1), "t3": (0, None, None, 0, 1)}


def test_purge(spark):
    files = spark.createDataFrame(
        [(1, "a/x.env", "d1", ""), (1, "a/x.env", "d1", ""), (2, "a/b/y.env", "d2", "c2"), (3, "keep.go", "d1", None), (4, "", "d4", None), (5, None, "d5", None), (6, "exact[1]", None, "c2")], "id long, path string, digest string, content_digest string"
    )
    gone = purges.purged_files(files, ["**/*.env", "exact[1]"])
    assert {r["id"] for r in gone.collect()} == {1, 2, 6}
    listing = spark.createDataFrame([("s", 1, "a/x.env"), ("s", 1, "a/x.env"), ("s", 3, "keep.go"), ("s", 9, "a/b/y.env"), ("t", 3, "keep.go"), ("t", 9, "a/x.env"), ("u", 2, None)], "snapshot string, id long, path string")
    counts = spark.createDataFrame([("s", 1), ("t", 5)], "snapshot string, file_count int")
    shots = purges.purge_snapshots(gone, listing, counts)
    assert sorted(map(tuple, shots.collect())) == [("s", 2, 0, 1), ("u", 1, None, 1)]  # t lists a purged path under another id only
    symbols = spark.createDataFrame([("f", 1), ("f", 2), ("g", 3)], "symbol string, id long")
    objects = spark.createDataFrame([("d1", 10), ("d1", 10), ("c2", 5), ("d4", 7)], "digest string, bytes long")
    assert tuple(purges.purge_totals(gone, symbols, objects, shots).first()) == (3, 2, 3, 15, 2)
    nothing = purges.purged_files(files, ["none"])
    assert tuple(purges.purge_totals(nothing, symbols, objects, purges.purge_snapshots(nothing, listing, counts)).first()) == (0, 0, 0, 0, 0)


def test_push_and_changeset(spark):
    nodes = spark.createDataFrame([("c", "ChangeSet", "{}"), ("f", "File", '{"a":1}'), ("g", "File", None)], "id string, kind string, payload string")
    asked = spark.createDataFrame([("f",), ("f",), ("absent",), ("g",), (None,)], "id string")
    assert sorted(map(tuple, purges.push_objects(nodes, asked).collect()), key=str) == [("f", "node", '{"a":1}'), ("g", "node", None)]
    edges = spark.createDataFrame([("c", "MODIFIES", "f"), ("c", "MODIFIES", "f"), ("c", "AFFECTS", "f"), ("c", "HAS", "absent"), ("c", "IMPORTS", "g"), ("f", "HAS", "g"), ("x", "HAS", "f")], "src string, type string, dst string")
    got = sorted(map(tuple, purges.changeset_graph(nodes, edges).collect()))
    assert got == [("c", "changeset", "c", "ChangeSet"), ("c", "edge", "absent", "HAS"), ("c", "edge", "f", "AFFECTS"), ("c", "edge", "f", "MODIFIES"), ("c", "node", "f", "File")]


SF = "/root/testdata/sf0.001"


def test_sentences_need_one_shuffle_of_the_lines(spark):
    rows = library.queries()["intent_sentences"](spark, SF)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    assert sum("Exchange hash" in line and "Reused" not in line for line in plan) == 1


@pytest.mark.parametrize("name", ["intent_sentences", "intent_report", "intent_scores", "intent_warnings"])
def test_large_clusters_have_the_same_words(spark, monkeypatch, name):
    want = sorted(library.queries()[name](spark, SF).collect())
    monkeypatch.setattr(src, "MANY", 4)
    assert len(src.dealt_lines(spark, SF)) == 2
    assert sorted(library.queries()[name](spark, SF).collect()) == want
