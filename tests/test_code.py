"""Hand-made cases and slow versions of the operators over files, imports, units, texts and signals."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from deltaloom.functions.paths import clean
from deltaloom.operators import activity, clusters, configs, graph, history, ignore, imports, merges, records, renames, resolver, selection, signals
from deltaloom.plans import code

# Renames


def byte_distance(a: str, b: str) -> int:
    x, y = a.encode(), b.encode()
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


@pytest.mark.parametrize(("a", "b", "distance"), [("", "", 0), ("a", "", 1), ("abc", "abd", 1), ("kitten", "sitting", 3), ("saturday", "sunday", 3), ("é", "e", 2)])
def test_distance_counts_bytes(spark, a, b, distance):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(renames.distance(F.col("a"), F.col("b")).alias("d"), renames.similarity(F.col("a"), F.col("b")).alias("s")).head()
    assert row.d == distance == byte_distance(a, b)
    assert row.s == (1.0 if a == b else 0.0 if not a or not b else 1 - distance / max(len(a.encode()), len(b.encode())))


def greedy(before, after, threshold=0.7):
    old, new = {(p, n): b for p, n, b in before}, {(p, n): b for p, n, b in after}
    pairs = []
    for (p, o), a in old.items():
        for (q, n), b in new.items():
            if p == q and a and b and (p, o) not in new and (p, n) not in old:
                s = round(1 - byte_distance(a, b) / max(len(a.encode()), len(b.encode())), 6)
                if s >= threshold:
                    pairs.append((-s, p, o, n))
    taken, out = set(), set()
    for s, p, o, n in sorted(pairs):
        if (p, "o", o) not in taken and (p, "n", n) not in taken:
            taken |= {(p, "o", o), (p, "n", n)}
            out.add((p, o, n, -s))
    return out


def test_renames_equal_a_sequential_greedy(spark, monkeypatch):
    monkeypatch.setattr(renames, "BLOCK", 3)  # a file with many functions is compared in blocks
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdé {}=;\n") for _ in range(n))
    before = [(f"f{rng.randrange(3)}", f"o{i}", text(rng.choice([0, 1, 2, 3, 5, 9, 30, 40]))) for i in range(50)] + [("f0", "same", "kept"), ("f1", "tie1", "zzzzzzzzzz"), ("f1", "tie2", "zzzzzzzzzz")]
    after = [("f0", "same", "kept, changed"), ("f1", "new1", "zzzzzzzzzz"), ("f1", "new2", "zzzzzzzzzy"), ("f9", "alone", "x")]
    for i, (p, _, b) in enumerate(before[:50]):
        edited = "".join(c if rng.random() > 0.2 else rng.choice("abx") for c in b)
        after.append((p, f"n{i}", edited))
    schema = "path string, name string, body string"
    got = renames.renamed(spark.createDataFrame([*before, (None, "x", "y"), ("f0", None, "y"), ("f0", "nobody", None)], schema), spark.createDataFrame(after, schema))
    assert {tuple(r) for r in got.collect()} == greedy(before, after)
    assert len(greedy(before, after)) > 20
    empty = spark.createDataFrame([], schema)
    assert renames.renamed(empty, empty).collect() == []


# Imports


def resolved(spark, rule, files, lines):
    got = rule(spark.createDataFrame([(f,) for f in files], "path string"), spark.createDataFrame(lines, "importer string, source string"))
    out = {}
    for r in got.collect():
        out.setdefault((r.importer, r.source), set()).add(r.file)
    return out


def test_paths_are_cleaned(spark):
    cases = {"a/./b": "a/b", "a/../b": "b", "../a": "../a", "a//b/": "a/b", "a/b/../../..": "..", ".": "", "x/../y/../z": "z"}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", clean(F.col("p")).alias("c")).collect()
    assert {r.p: r.c for r in rows} == cases


def test_go_imports_take_the_longest_tail(spark):
    files = ["kai/internal/graph/graph.go", "kai/internal/graph/more.go", "other/graph/g.go", "kai/main.go", "utils/u.go", "a/utils/v.go", "notes.md"]
    lines = [("kai/main.go", "x/internal/graph"), ("kai/main.go", "y/graph"), ("kai/main.go", "fmt"), ("utils/u.go", "z/utils"), ("other/graph/g.go", "q/other/graph"), (None, "a/b"), ("kai/main.go", None), ("kai/main.go", "y/graph")]
    assert resolved(spark, imports.go, files, lines) == {
        ("kai/main.go", "x/internal/graph"): {"kai/internal/graph/graph.go", "kai/internal/graph/more.go"},
        ("kai/main.go", "y/graph"): {"kai/internal/graph/graph.go", "kai/internal/graph/more.go", "other/graph/g.go"},
        ("utils/u.go", "z/utils"): {"a/utils/v.go"},
        ("other/graph/g.go", "q/other/graph"): {"kai/internal/graph/graph.go", "kai/internal/graph/more.go"},
    }


def test_script_imports_in_order(spark):
    files = ["src/a.ts", "src/b.js", "src/b.ts", "src/c/index.tsx", "src/d.service.ts", "index.js", "src/e.js"]
    lines = [("src/a.ts", "./b"), ("src/a.ts", "./c"), ("src/a.ts", "./d.service"), ("src/a.ts", ".."), ("src/a.ts", "./e.js"), ("src/a.ts", "./e.ts"), ("src/a.ts", "lodash"), ("index.js", "./src/c")]
    assert resolved(spark, imports.script, files, lines) == {
        ("src/a.ts", "./b"): {"src/b.ts"}, ("src/a.ts", "./c"): {"src/c/index.tsx"}, ("src/a.ts", "./d.service"): {"src/d.service.ts"},
        ("src/a.ts", ".."): {"index.js"}, ("src/a.ts", "./e.js"): {"src/e.js"}, ("index.js", "./src/c"): {"src/c/index.tsx"},
    }


def test_python_ruby_and_rust_imports(spark):
    files = ["auth/token.py", "auth/__init__.py", "pkg/data.txt", "top.py"]
    lines = [("m.py", "auth.token"), ("m.py", "auth.token.validate"), ("m.py", "auth"), ("m.py", "auth.missing.name"), ("m.py", "os.path"), ("m.py", "top")]
    assert resolved(spark, imports.python, files, lines) == {
        ("m.py", "auth.token"): {"auth/token.py"}, ("m.py", "auth.token.validate"): {"auth/token.py"}, ("m.py", "auth"): {"auth/__init__.py"},
        ("m.py", "auth.missing.name"): {"auth/__init__.py"}, ("m.py", "top"): {"top.py"},
    }
    files = ["app/models/user.rb", "app/controllers/posts_controller.rb", "app/models/admin/user.rb", "lib/payment_gateway.rb", "app/models/concerns/issuable.rb", "config/routes.rb", "lib/tool.rb"]
    lines = [("x.rb", "autoload:User"), ("x.rb", "autoload:Admin::User"), ("x.rb", "autoload:Outer::PostsController"), ("app/models/user.rb", "autoload:User"), ("x.rb", "autoload:Issuable"), ("x.rb", "autoload:Routes"), ("x.rb", "tool"), ("lib/tool.rb", "./payment_gateway")]
    assert resolved(spark, imports.ruby, files, lines) == {
        ("x.rb", "autoload:User"): {"app/models/user.rb"}, ("x.rb", "autoload:Admin::User"): {"app/models/admin/user.rb"}, ("x.rb", "autoload:Outer::PostsController"): {"app/controllers/posts_controller.rb"},
        ("x.rb", "autoload:Issuable"): {"app/models/concerns/issuable.rb"}, ("x.rb", "tool"): {"lib/tool.rb"}, ("lib/tool.rb", "./payment_gateway"): {"lib/payment_gateway.rb"},
    }
    files = ["src/main.rs", "src/foo.rs", "src/foo/bar.rs", "src/net/mod.rs", "src/net/http.rs", "crates/x/src/lib.rs", "crates/x/src/y.rs"]
    lines = [("src/main.rs", "mod:foo"), ("src/foo.rs", "mod:bar"), ("src/main.rs", "mod:net"), ("src/main.rs", "crate::foo::bar::Baz"), ("src/net/http.rs", "super::foo::X"), ("src/net/http.rs", "self::*"), ("crates/x/src/lib.rs", "crate::y::Z"), ("src/main.rs", "std::io"), ("src/main.rs", "crate::*")]
    assert resolved(spark, imports.rust, files, lines) == {
        ("src/main.rs", "mod:foo"): {"src/foo.rs"}, ("src/foo.rs", "mod:bar"): {"src/foo/bar.rs"}, ("src/main.rs", "mod:net"): {"src/net/mod.rs"}, ("src/main.rs", "crate::foo::bar::Baz"): {"src/foo/bar.rs"},
        ("src/net/http.rs", "super::foo::X"): {"src/foo.rs"}, ("src/net/http.rs", "self::*"): {"src/net/mod.rs"}, ("crates/x/src/lib.rs", "crate::y::Z"): {"crates/x/src/y.rs"}, ("src/main.rs", "crate::*"): {"src/foo.rs"},
    }


# Configuration files


def slow_changes(path, b, a):
    kind = lambda v: "number" if isinstance(v, (int, float)) and not isinstance(v, bool) else type(v).__name__
    if kind(b) != kind(a):
        return [(path, "JSON_VALUE_CHANGED")]
    if isinstance(b, dict):
        at = lambda k: f"{path}.{k}" if path else k
        out = [(at(k), "JSON_FIELD_REMOVED") for k in b if k not in a] + [(at(k), "JSON_FIELD_ADDED") for k in a if k not in b]
        return out + [x for k in b if k in a for x in slow_changes(at(k), b[k], a[k])]
    if isinstance(b, list):
        return [(path, "JSON_ARRAY_CHANGED")] if b != a else []
    return [(path, "JSON_VALUE_CHANGED")] if b != a else []


def test_json_changes_equal_a_recursion(spark):
    rng = random.Random(9)

    def value(depth):
        k = rng.randrange(9 if depth else 5)
        if k < 5:
            return [None, True, rng.choice([1, 1.0, 2, 2.5]), rng.choice(["a", "1", ""]), False][k]
        return [value(depth - 1) for _ in range(rng.randrange(3))] if k < 7 else {rng.choice("abc.d"): value(depth - 1) for _ in range(rng.randrange(4))}

    pairs = [(i, json.dumps(value(4)), json.dumps(value(4))) for i in range(150)] + [(200, '{"a":{"b":[1,{"c":1}]}}', '{"a":{"b":[1.0,{"c":1.0}]}}'), (201, '{"a":[[1],2]}', '{"a":[[2],2]}')]
    rows = [*pairs, (300, "{", "{}"), (301, None, "{}"), (302, '"x"', '"y"'), (303, '{"a":{"deep":{"er":1}}}', "{}")]
    df = spark.createDataFrame(rows, "id int, before string, after string")
    want = sorted((i, *c) for i, b, a in [*pairs, *rows[-2:]] for c in slow_changes("", json.loads(b), json.loads(a)))
    assert sorted(map(tuple, configs.json_changes(df, ["id"]).collect())) == want
    assert {r.id for r in configs.invalid(df, ["id"]).collect()} == {300, 301}
    assert configs.json_changes(df.limit(0), ["id"]).collect() == []


def test_rows_of_plain_texts_are_written_once_however_deep(spark, monkeypatch):
    deep = lambda x: json.dumps({"a": {"b": {"c": {"d": {"e": x}}}}, "limits": {"max": x}})
    df = spark.createDataFrame([(1, deep(1), deep(2))], "id int, before string, after string")
    times, settled = [], configs.settled
    monkeypatch.setattr(configs, "settled", lambda rows: times.append(1) or settled(rows))
    want = [(1, "a.b.c.d.e", "general", "JSON_VALUE_CHANGED"), (1, "limits.max", "limit", "LIMIT_CHANGED")]
    assert sorted(map(tuple, configs.enriched(configs.json_changes(df, ["id"])).select("id", "path", "key_category", "category").collect())) == want and len(times) == 1


def test_config_pairs_are_dealt_out_once(spark):
    plan = code.config_pairs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and plan.count("Exchange ") == 1


def test_package_changes_are_merged_without_a_join(spark):
    plan = code.package_diff(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_changes_of_plain_texts_need_no_shuffle(spark):
    plan = code.json_diff(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_texts_that_parsers_read_differently_have_the_changes_of_variants(spark):
    texts = ['{"a":1} x', '{"a":1,"a":2}', '{"a":NaN}', "", '{"a":"\\ud800"}', "1", "12x", "null", "[1,2]", "[true]", '{"a":1e400}', '{"a":-0}', '{"a":0}', '{"a":[0]}', '{"a.b":1}', '{"a":{"b":1}}', '{"":{"a":[true]}}', '{"dependencies":{"x":"1","y":{"z":"1"}}}', "[" * 300 + "]" * 300, None]
    df = spark.createDataFrame([(i * 100 + j, b, a) for i, b in enumerate(texts) for j, a in enumerate(texts)], "id int, before string, after string")
    slow = configs.by_levels(df, ["id"])
    assert sorted(configs.json_changes(df, ["id"]).collect()) == sorted(slow.collect())
    assert sorted(configs.package_changes(df, ["id"]).collect()) == sorted(configs.merged_changes(configs.dependency_changes(df, ["id"]), slow, ["id"]).collect())


def test_a_task_keeps_few_texts_and_paths(spark, monkeypatch):
    documents = configs.Documents()
    b, a = documents[b'{"a":{"b":1,"c":[1]},"a.b":2}'], documents[b'{"a":{"b":2,"c":[1.0]},"a.b":3,"d":{"e":1}}']
    assert sorted((documents.names[x >> 3], configs.CATEGORIES[x & 7]) for x in documents.changes(b, a)) == [("a.b", "JSON_VALUE_CHANGED"), ("d", "JSON_FIELD_ADDED")]
    documents[b"[" + b"1," * 20_000 + b"1]"]
    assert documents.room < configs.KEPT - 40_000 and not documents.full()
    df = spark.createDataFrame([(i, json.dumps({f"k{i}": 1}), json.dumps({f"k{i}": i})) for i in range(50)], "id int, before string, after string")
    monkeypatch.setattr(configs, "KEPT", 100)
    assert configs.json_changes(df, ["id"]).count() == 49


def test_dependency_signals_cover_what_lies_on_their_way(spark):
    b = {"dependencies": {"a": "^1.2", "b": "2.0", "n": 7}, "scripts": {"x": "1"}}
    a = {"dependencies": {"a": "^2.0", "c": "1.0", "n": 8}, "scripts": {"x": "2"}, "peerDependencies": {"p": ">=1"}}
    df = spark.createDataFrame([(1, json.dumps(b), json.dumps(a))], "id int, before string, after string")
    deps, changes = configs.dependency_changes(df, ["id"]), configs.json_changes(df, ["id"])
    assert {(r.path, r.category, tuple(r.tags)) for r in deps.collect()} == {
        ("dependencies.a", "DEPENDENCY_UPDATED", ("config", "breaking")), ("dependencies.b", "DEPENDENCY_REMOVED", ("config", "breaking")),
        ("dependencies.c", "DEPENDENCY_ADDED", ("config",)), ("peerDependencies.p", "DEPENDENCY_ADDED", ("config",)),
    }
    merged = {(r.path, r.category) for r in configs.merged_changes(deps, changes, ["id"]).collect()}
    assert merged - {(r.path, r.category) for r in deps.collect()} == {("scripts.x", "JSON_VALUE_CHANGED"), ("dependencies.n", "JSON_VALUE_CHANGED")}


# Merges


def test_text_merges(spark):
    base = "1\n2\n3\n4\n"
    cases = [
        (base, base, "x\n", "right", "x\n"), (base, "y\n", base, "left", "y\n"), (base, "z\n", "z\n", "left", "z\n"), (base, "L\n" + base, base + "R", "left then right", "L\n" + base + "R"),
        (base, base + "L", "R\n" + base, "right then left", "R\n" + base + "L"), (base, base.replace("2", "l"), base.replace("2", "r"), "conflict", None), (base, base.replace("2", "l"), base.replace("3", "r"), "left then right", "1\nl\nr\n4\n"),
        ("", "a", "b", "left then right", "ab"), (None, None, "b", "right", "b"), ("a\nb", "a\nb\nc", "x\na\nb", "right then left", "x\na\nb\nc"), (base, base.replace("2\n", ""), base.replace("3\n", ""), "left then right", "1\n4\n"),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "id int, base string, left string, right string")
    got = {r.id: (r.decision, r.merged) for r in merges.merged_texts(df).collect()}
    assert got == {i: c[3:] for i, c in enumerate(cases)} or {i: (g, cases[i]) for i, g in got.items() if g != tuple(cases[i][3:])} == {}


@pytest.mark.parametrize(
    ("kind", "base", "left", "right", "decision", "conflict"),
    [
        ("function", ("s", "b"), ("s", "l"), ("s", "b"), "left", None), ("function", ("s", "b"), ("s", "b"), ("s", "r"), "right", None), ("function", ("s", "b"), ("s", "x"), ("s", "x"), "left", None),
        ("function", ("s", "b"), ("s", "l"), ("s", "r"), "conflict", "BODY_DIVERGED"), ("function", ("s", "b"), ("l", "l"), ("r", "r"), "conflict", "API_SIGNATURE_DIVERGED"), ("method", ("s", "b"), ("l", "l"), ("s", "r"), "left", None),
        ("function", ("s", "b"), ("s", "l"), ("r", "r"), "right", None), ("const", ("s", "b"), ("s", "l"), ("s", "r"), "conflict", "CONST_VALUE_CONFLICT"), ("import", ("s", "b"), ("s", "l"), ("s", "r"), "conflict", "IMPORT_ALIAS_CONFLICT"),
        ("class", ("s", "b"), ("s", "l"), ("s", "r"), "conflict", "BODY_DIVERGED"), ("function", ("s", "b"), None, ("s", "r"), "conflict", "DELETE_vs_MODIFY"), ("function", ("s", "b"), ("s", "l"), None, "conflict", "MODIFY_vs_DELETE"),
        ("function", ("s", "b"), None, ("s", "b"), "deleted", None), ("function", ("s", "b"), None, None, "deleted", None), ("function", None, ("s", "l"), ("s", "r"), "conflict", "CONCURRENT_CREATE"),
        ("function", None, ("s", "l"), ("s", "l"), "left", None), ("function", None, None, ("s", "r"), "right", None), ("function", ("s", "b"), ("s", "b"), ("s", "b"), "base", None),
    ],
)
def test_unit_merges(spark, kind, base, left, right, decision, conflict):
    schema = "path string, key string, kind string, signature string, content string, line int, col int"
    side = lambda x: spark.createDataFrame([("f", "u", kind, *x, 1, 0)] if x else [], schema)
    row = merges.merged_units(side(base), side(left), side(right)).head()
    assert (row.decision, row.conflict) == (decision, conflict)


def test_files_are_rebuilt_by_place(spark):
    schema = "path string, key string, kind string, signature string, content string, line int, col int"
    base = spark.createDataFrame([("f", "a", "const", "", "a=1", 1, 0), ("f", "b", "const", "", "b=1", 3, 0), ("g", "c", "const", "", "c=1", 1, 0)], schema)
    left = spark.createDataFrame([("f", "a", "const", "", "a=2", 1, 0), ("f", "b", "const", "", "b=1", 3, 0), ("f", "n", "const", "", "n=1", 2, 5), ("g", "c", "const", "", "c=2", 1, 0)], schema)
    right = spark.createDataFrame([("f", "a", "const", "", "a=1", 1, 0), ("f", "m", "const", "", "m=1", 2, 1), ("g", "c", "const", "", "c=3", 1, 0)], schema)
    got = {r.path: (r.conflicts, r.content) for r in merges.rebuilt_files(merges.merged_units(base, left, right)).collect()}
    assert got == {"f": (0, "a=2\n\nm=1\n\nn=1\n"), "g": (1, None)}


# Closures and components


def test_each_test_reaches_what_it_imports(spark):
    edges = [("tests/a.test", "x"), ("x", "y"), ("y", "x"), ("tests/b.test", "tests/a.test"), ("z", "tests/a.test"), ("y", "w"), ("tests/c.test", "tests/c.test")]
    got = graph.test_edges(spark.createDataFrame(edges, "src string, dst string")).collect()
    assert {(r.test, r.path) for r in got} == {("tests/a.test", p) for p in "xyw"} | {("tests/b.test", p) for p in "xyw"}


def test_components_equal_union_find(spark, monkeypatch):
    monkeypatch.setattr(graph, "FOREST", 5)
    rng = random.Random(2)
    pairs = [(str(rng.randrange(300)), str(rng.randrange(300))) for _ in range(220)] + [("900", "900"), ("500", "501"), ("501", "502")] + [("0", str(i)) for i in range(600, 660)] + [(None, "1")]
    root = {}
    top = lambda x: x if root.setdefault(x, x) == x else top(root[x])
    for a, b in pairs:
        if a is not None:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    got = graph.components(spark.createDataFrame(pairs, "a string, b string").repartition(6)).collect()
    assert {r.node: r.root for r in got} == {x: top(x) for x in root}


# Clusters


def slow_seeds(rows):
    out, seeds = {}, []
    for pos, x in sorted(rows):
        for s, y in seeds:
            share = lambda c: len(set(x[c]) & set(y[c])) / max(len(x[c]), len(y[c]), 1)  # noqa: E731, B023
            near = (((0.4 if x["path"] == y["path"] else 0.0) + 0.3 * share("symbols")) + (0.2 if x["category"] == y["category"] else 0.0)) + 0.1 * share("tags")
            if near > 0.3:
                out[pos] = s
                break
        else:
            seeds.append((pos, x))
            out[pos] = pos
    return out


def test_the_split_equals_a_pass_in_order(spark):
    rng = random.Random(6)
    pick = lambda names, n: sorted(rng.sample(names, rng.randrange(n)))
    groups = {c: [(i, {"path": rng.choice("abcdefghijklmnop"), "category": rng.choice("XYZ"), "symbols": pick(list("stuvw"), 4), "tags": pick(["t1", "t2", "t3"], 3)}) for i in rng.sample(range(500), 60)] for c in ("one", "two", "three")}
    rows = [(c, i, x) for c, members in groups.items() for i, x in members]
    df = spark.createDataFrame(rows, "cluster string, pos long, x struct<path: string, category: string, symbols: array<string>, tags: array<string>>")
    got = {(r.cluster, r.pos): r.seed for r in clusters.seeded(df).collect()}
    assert got == {(c, i): s for c, members in groups.items() for i, s in slow_seeds(members).items()}
    assert clusters.seeded(df.limit(0)).collect() == []


def test_single_signals_join_the_first_larger_cluster(spark):
    schema = "change int, id long, module string, path string, category string, confidence double, symbols array<string>, tags array<string>"
    signal = lambda i, module, path: (1, i, module, path, "OTHER", 0.9, [], None)
    rows = [signal(1, "m", "b/x.go"), signal(2, "m", "b/y.go"), signal(3, "m", "c/z.go"), signal(4, "m", "a/q.go"), signal(5, "k", "d/1.go"), signal(6, "k", "e/2.go"), signal(7, None, "f/3.go"), signal(8, "m", "g/4.go"), signal(9, "m", "h/5.go")]
    known = spark.createDataFrame([("g/4.go", "h/5.go"), ("d/1.go", "nowhere.go")], "importer string, file string")
    got = {r.id: (r.module, r.cluster) for r in clusters.clustered(spark.createDataFrame(rows, schema), known).collect()}
    assert got == {1: ("m", "b/x.go"), 2: ("m", "b/x.go"), 3: ("m", "b/x.go"), 4: ("m", "b/x.go"), 5: ("k", "d/1.go"), 6: ("k", "d/1.go"), 7: ("General", "f/3.go"), 8: ("m", "g/4.go"), 9: ("m", "g/4.go")}


# Signals


def test_clusters_count_unknown_names_and_null_tags(spark):
    rows = [("c", "NEW_KIND", 1.0, None, "a.md"), ("c", "NEW_KIND", 1.0, "t", "b.go"), ("c", "FUNCTION_ADDED", 0.5, "t", "b.go"), ("d", "OTHER", 1.0, None, "a.go")]
    df = spark.createDataFrame(rows, "cluster string, category string, confidence double, tag string, path string")
    got = {r.cluster: r for r in signals.clusters(df).collect()}
    assert (got["c"].n, got["c"].files, got["c"].kinds, got["c"].most_category, got["c"].most_tag, got["c"].c_FUNCTION_ADDED, got["c"].doc) == (3, 2, 2, 2, 2, 1, True)
    assert {r.cluster: r.cohesion for r in signals.cohesion(df).collect()}["d"] == 1.0


def test_areas_take_symbols_then_files_then_directories(spark):
    rows = [(1, "f", "a/x.go"), (1, "g", "a/x.go"), (1, "g", "b/y.go"), (2, None, "a/x.go"), (2, None, "a/x.go"), (3, None, "src/a/x.go"), (3, None, "src/b/y.go"), (4, None, None)]
    got = records.primary_areas(spark.createDataFrame(rows, "cluster int, symbol string, path string")).collect()
    assert {r.cluster: r.area for r in got} == {1: "g", 2: "x", 3: "src", 4: "codebase"}


# Symbols, conditions, agents


def test_symbols_are_added_removed_signed_anew_or_set_anew(spark):
    schema = "path string, name string, kind string, signature string, value string"
    before = [("f", "gone", "function", "()", None), ("f", "same", "function", "()", "1"), ("f", "wide", "function", "(a)", None), ("f", "limit", "const", "", "1"), ("f", "body", "function", "()", "1")]
    after = [("f", "come", "function", "()", None), ("f", "same", "function", "()", "1"), ("f", "wide", "function", "(a, b)", None), ("f", "limit", "const", "", "2"), ("f", "body", "function", "()", "2"), ("g", "gone", "function", "()", None)]
    got = {(r.path, r.name): (r.action, r.change) for r in history.symbol_diff(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema)).collect()}
    assert got == {("f", "gone"): ("removed", None), ("g", "gone"): ("added", None), ("f", "come"): ("added", None), ("f", "wide"): ("modified", "API_SURFACE_CHANGED"), ("f", "limit"): ("modified", "CONSTANT_UPDATED")}


def test_near_nodes_meet_across_stretches(spark):
    rng = random.Random(3)
    nodes = lambda n: [(rng.choice("ab"), rng.choice("xy"), i, rng.randrange(-5, 30), rng.randrange(30), rng.choice(["a<1", "a<2", "b<1", "a<=1"])) for i in range(n)]
    before, after, schema = nodes(60), nodes(60), "file string, type string, id int, line int, col int, text string"
    frames = spark.createDataFrame(before, schema), spark.createDataFrame(after, schema)
    pairs = {(b[2], a[2]) for b in before for a in after if b[:2] == a[:2] and abs(b[3] - a[3]) <= 2 and b[5] != a[5]}
    got = history.near_pairs(*frames).collect()
    assert len(got) == len(pairs) and {(r.before_id, r.after_id) for r in got} == pairs
    texts = {b[2]: b[5] for b in before}, {a[2]: a[5] for a in after}
    operator = lambda t: t.strip("ab12")
    assert {(r.before_id, r.after_id) for r in history.condition_changes(*frames).collect()} == {(i, j) for i, j in pairs if operator(texts[0][i]) != operator(texts[1][j]) or texts[0][i][-1] != texts[1][j][-1]}
    place = {b[2]: b[4] for b in before}, {a[2]: a[4] for a in after}
    assert {(r.before_id, r.after_id) for r in history.near_pairs(*frames, columns=10).collect()} == {(i, j) for i, j in pairs if abs(place[0][i] - place[1][j]) <= 10}


def test_agents_share_files_and_neighbours(spark):
    changes = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "z"), (1, "a"), (None, "q"), (4, None)], "agent int, file string")
    links = spark.createDataFrame([("a", "c"), ("c", "b"), ("z", "q"), ("z", "z")], "a string, b string")
    assert {tuple(r) for r in history.merge_check(changes, links).collect()} == {(1, 2, 1, 1), (2, 2, 1, 1), (3, 1, 0, 0)}


def test_sweeps_equal_a_line_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(history, "STRETCH", 7)
    rng = random.Random(5)
    rows = []
    for i in range(120):
        start = rng.randrange(60)
        rows.append((rng.choice("fg"), start, start + rng.randrange(12), rng.choice(["ai", "human"]), rng.choice(["", "x"]), rng.randrange(5), i % 50))
    last = {}
    for f, s, e, kind, agent, ts, seq in rows:
        for line in range(s, e + 1):
            last[f, line] = max(last.get((f, line), (-1,)), (ts, seq, kind, agent))
    df = spark.createDataFrame(rows, "file string, start_line int, end_line int, author_type string, agent string, ts int, seq int").withColumn("ts", F.timestamp_seconds("ts")).repartition(5)
    got = history.consolidated(df).collect()
    lines = {(r.file, n): (r.author_type, r.agent) for r in got for n in range(r.start_line, r.end_line + 1)}
    assert lines == {k: v[2:] for k, v in last.items()}
    ends = {(r.file, r.end_line + 1, r.author_type, r.agent) for r in got}
    assert not [r for r in got if (r.file, r.start_line, r.author_type, r.agent) in ends]  # runs are as long as they can be
    assert history.consolidated(df.limit(0)).collect() == []


# Numbers


def test_places_in_sorted_values_by_ranges(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.randrange(5), rng.random() * 100])) for _ in range(400)] + [("c", 1.0), ("d", None)]
    rows = [(k, None if v is None else float(v)) for k, v in rows]
    df = spark.createDataFrame(rows, "key string, value double").repartition(7)
    got = {r.key: (r.p0, r.p33, r.p100) for r in activity.percentiles(df, ["key"], "value", {"p0": 0.0, "p33": 0.33, "p100": 1.0}).collect()}
    for key in ("a", "b", None, "c"):
        values = sorted(v for k, v in rows if k == key and v is not None)
        at = lambda p: (len(values) - 1) * p  # noqa: E731, B023
        want = [values[int(at(p))] + (values[min(len(values) - 1, int(at(p)) + (at(p) % 1 > 0))] - values[int(at(p))]) * (at(p) % 1) for p in (0.0, 0.33, 1.0)]  # noqa: B023
        assert all(abs(x - y) < 1e-9 for x, y in zip(got[key], want, strict=True))
    assert "d" not in got
    middle = {r.key: r.upper_median for r in activity.upper_median(df.where("key IS NOT NULL"), "key", "value").collect()}
    assert middle == {k: sorted(v for q, v in rows if q == k)[len([1 for q, _ in rows if q == k]) // 2] for k in "abc"}


def test_reductions_blend_fallbacks_and_compare_sums(spark):
    runs = [("r", "baseline", 10.0, None, None, 0, 0), ("r", "selective", 4.0, 1000.0, False, 100, 25), ("r", "selective", 4.0, 1000.0, True, 100, 25), ("s", "baseline", 2.0, None, None, 0, 0), ("s", "selective", 1.0, 0.0, True, 10, 10), ("t", "selective", 1.0, 500.0, False, 10, 5)]
    got = {r.repo: tuple(r)[1:] for r in activity.reductions(spark.createDataFrame(runs, "repo string, mode string, seconds double, plan_ms double, fallback boolean, tests_total int, tests_selected int")).collect()}
    assert got == {"r": (10000, 5000, 7500, 0.5, 25.0, 75.0), "s": (2000, 1000, 2000, 1.0, 0.0, 0.0), "t": (0, 1500, 1500, 0.0, 0.0, 50.0), "all": (12000, 6000, 9500, None, 20.8, 70.5)}


def test_failures_are_missed_flaky_or_fallbacks(spark):
    runs = [("a", 1, "error", 50.0, 1), ("a", 1, "view", 1.0, 2), ("b", 1, "view", 1.0, 1), ("b", 1, "error", 50.0, 2), ("c", 1, "error", 5.0, 1), ("d", 1, "click", 5.0, 1), ("d", 1, "view", 3.0, 1)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(runs)], "repo string, test int, event_type string, value double, ts int, event_id int")
    kind = lambda k: F.col("event_type") == k
    assert {r.repo: r.verdict for r in activity.repo_verdicts(df, kind("error"), kind("view"), kind("click"), 30).collect()} == {"a": "flaky", "b": "missed", "c": "fallback", "d": "safe"}


def test_totals_are_added_to_stored_rows(spark):
    schema = "session string, tokens_in long, tokens_out long"
    stored, more = spark.createDataFrame([("a", 5, 1), ("b", 2, 2)], schema), spark.createDataFrame([("a", 1, 0), ("a", 2, None), ("c", 4, 4)], schema)
    assert {tuple(r) for r in records.accumulated(stored, more, "session").collect()} == {("a", 8, 1), ("b", 2, 2), ("c", 4, 4)}
    pairs = spark.createDataFrame([(1, "a(b, a)", "a(b)"), (2, "", " "), (3, "x", ""), (4, "x y", "y\tx")], "id int, a string, b string")
    got = {r.id: round(r.similarity, 6) for r in records.token_similarities(pairs, ["id"], "a", "b").collect()}
    assert got == {1: round(4 / 6, 6), 2: 1.0, 3: 0.0, 4: 1.0}


# Names, rules, tests


def test_names_are_looked_up_in_order(spark):
    ids = [f"{'ab' * 5}{i:054x}" for i in range(12)] + ["cd" * 32]
    kinds = ["Snapshot" if i % 2 else "ChangeSet" for i in range(13)]
    nodes = spark.createDataFrame(list(zip(ids, kinds, strict=True)), "id string, kind string")
    log = spark.createDataFrame([(k, n, i) for n, (i, k) in enumerate(zip(ids, kinds, strict=True))], "kind string, seq long, id string")
    slugs, refs = spark.createDataFrame([("one", ids[1]), ("both", ids[2])], "slug string, id string"), spark.createDataFrame([("main", ids[3], "Snapshot"), ("both", ids[5], "Snapshot")], "name string, id string, kind string")
    asked = [(ids[4].upper(), None), (ids[4], "Snapshot"), ("0" * 64, None), ("one", None), ("both", "Snapshot"), ("both", None), ("main", "ChangeSet"), ("@snap:last", None), ("@snap:prev~1", None), ("@cs:last~99", None), ("CDCDCDCD", None), ("abababab", None), ("abababab", "Snapshot"), ("ababab", None), (None, None), ("@ws:last", None)]
    got = {(r.input, r.want): r for r in resolver.resolved(spark.createDataFrame(asked, "input string, want string"), nodes, slugs, refs, log).collect()}
    told = {k: (r.status, r.id) for k, r in got.items()}
    assert told == {
        asked[0]: ("found", ids[4]), asked[1]: ("wrong_kind", ids[4]), asked[2]: ("not_found", "0" * 64), asked[3]: ("found", ids[1]), asked[4]: ("found", ids[5]), asked[5]: ("found", ids[2]), asked[6]: ("not_found", None), asked[7]: ("found", ids[11]),
        asked[8]: ("found", ids[7]), asked[9]: ("not_found", None), asked[10]: ("found", ids[12]), asked[11]: ("ambiguous", None), asked[12]: ("ambiguous", None), asked[13]: ("not_found", None), asked[14]: ("not_found", None), asked[15]: ("not_found", None),
    }
    assert got[asked[11]].candidates == ids[:10] and got[asked[12]].candidates == ids[1:12:2]


def test_the_last_rule_decides(spark):
    lines = ["# note", "", "*.log", "!keep.log", "/build/", "docs/**/tmp", "node_modules", "gen/ @semantic-ignore", "!gen/kept/**", "a?c.[ch]", "x.{js,ts}"]
    cases = {
        "a.log": (False, False), "b/keep.log": (True, True), "build/x": (False, False), "src/build/x": (True, True), "build": (True, True), "docs/tmp": (False, False), "docs/a/b/tmp/f": (False, False), "p/node_modules/q.js": (False, False),
        "gen/f.go": (True, False), "gen/kept/f.go": (True, True), "abc.h": (False, False), "abbc.h": (True, True), "d/x.ts": (False, False), "./a.log": (False, False), "keep.log/x.log": (True, True),
    }
    got = ignore.judged(spark.createDataFrame([(p,) for p in cases], "path string"), lines).collect()
    assert {r.path: (r.captured, r.analysed) for r in got} == cases


@pytest.mark.parametrize(
    ("row", "start", "fallback", "want"),
    [
        (("src/a/loader.js", True, False), "nearest_module", True, None), (("src/a/loader.js", False, True), "nearest_module", True, None), (("src/a/loader.js", False, False), "nearest_module", True, ("nearest_module", 2)),
        (("src/a/loader.js", False, False), "package", True, ("package", 2)), (("src/a/loader.js", False, False), "full_suite", False, ("full_suite", 4)), (("unknown/loader.js", False, False), "nearest_module", True, ("full_suite", 4)),
        (("unknown/loader.js", False, False), "nearest_module", False, (None, 0)),
    ],
)
def test_unbounded_imports_ask_for_more_tests(spark, row, start, fallback, want):
    tests = spark.createDataFrame([("src/a/a.test.js",), ("src/a/a2.test.js",), ("src/b/b.test.js",), ("src/c/c.test.js",)], "path string")
    modules = spark.createDataFrame([("A", "src/a"), ("B", "src/b"), ("C", "src/c")], "module string, prefix string")
    imports_ = spark.createDataFrame([(1, *row)], "change int, path string, bounded boolean, allowlisted boolean")
    got = [(r.strategy, r.tests) for r in selection.expanded(imports_, tests, modules, start, fallback).collect()]
    assert got == ([want] if want else [])


def test_coverage_of_three_formats(spark):
    nyc = '{"/app/u.js":{"path":"/app/u.js","statementMap":{"0":{"start":{"line":1}},"1":{"start":{"line":2}},"2":{"start":{"line":5}}},"s":{"0":10,"1":5,"2":0}},"/app/a.js":{"path":"/app/a.js","statementMap":{"0":{"start":{"line":10}}},"s":{"0":3}}}'
    py = '{"files":{"src/main.py":{"executed_lines":[1,2,3,10,15]},"src/util.py":{"executed_lines":[5,6,7]}}}'
    xml = '<?xml version="1.0"?><report name="r"><package name="com/x"><sourcefile name="A.java"><line nr="3" ci="4"/><line nr="4" ci="0"/></sourcefile></package></report>'
    rows = [(1, "coverage-final.json", nyc), (2, "coverage.json", py), (3, "jacoco.xml", xml), (4, "x.txt", "zz"), (5, "coverage-final.json", "{bad"), (6, "jacoco.xml", "<rep"), (7, "coverage.json", None), (8, "coverage.xml", "<jacoco version='1.0'>")]
    lines, rejects = selection.covered_lines(spark.createDataFrame(rows, "report int, name string, content string"))
    found = {}
    for r in lines.collect():
        found.setdefault((r.format, r.path), set()).add((r.line, r.hits))
    assert found == {("nyc", "/app/u.js"): {(1, 10), (2, 5)}, ("nyc", "/app/a.js"): {(10, 3)}, ("coveragepy", "src/main.py"): {(n, 1) for n in (1, 2, 3, 10, 15)}, ("coveragepy", "src/util.py"): {(5, 1), (6, 1), (7, 1)}, ("jacoco", "com/x/A.java"): {(3, 4)}}
    assert {r.report: r.format for r in rejects.collect()} == {4: None, 5: "nyc", 6: "jacoco", 7: None, 8: "jacoco"}
