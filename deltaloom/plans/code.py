"""Queries over files, their imports, units and versions, with the DuckDB SQL of each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from deltaloom.operators import clusters, configs, graph, history, imports, merges, renames
from deltaloom.plans.catalogue import EDGES, SIGNALS
from deltaloom.plans.registry import query
from deltaloom.sources import tables as src

# The views of files and of import lines, in SQL.
TREE = """tree AS (SELECT p_partkey, CASE p_partkey % 5
  WHEN 0 THEN 'svc/' || b || '/' || t || '/f' || p_partkey || '.go'
  WHEN 1 THEN 'web/' || b || '/' || t || '/' || CASE p_size % 3 WHEN 0 THEN 'm' || p_size || '.tsx' WHEN 1 THEN 'index.ts' ELSE 'm' || p_size || '/index.js' END
  WHEN 2 THEN 'py/' || t || '/' || CASE WHEN p_size % 4 = 0 THEN '__init__' ELSE b END || '.py'
  WHEN 3 THEN 'app/models/' || t || '/' || b || '_x' || left(p_size::VARCHAR, 1) || '.rb'
  ELSE 'core/src/' || b || '/' || CASE WHEN p_size % 4 = 0 THEN 'mod' ELSE t END || '.rs' END AS path
  FROM (SELECT *, replace(lower(p_brand), '#', '') AS b, lower(p_type) AS t FROM part)),
files AS (SELECT DISTINCT path, CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir FROM tree)"""
LINES = """lines AS (SELECT DISTINCT path AS importer, regexp_replace(path, '/[^/]*$', '') AS own, CASE l_partkey % 5
  WHEN 0 THEN CASE w WHEN 0 THEN 'example/svc/' || b || '/' || t WHEN 1 THEN 'other/mod/' || t ELSE 'fmt' END
  WHEN 1 THEN CASE w WHEN 0 THEN './m' || q WHEN 1 THEN '../' || t || '/m' || q ELSE '../../' || b || '/./' || t END
  WHEN 2 THEN CASE w WHEN 0 THEN 'py.' || t || '.' || b WHEN 1 THEN 'py.' || t || '.Name' ELSE t || '.' || b END
  WHEN 3 THEN CASE w WHEN 0 THEN 'autoload:' || upper(t[1]) || t[2:] || '::B' || b[2:] || 'X' || left(q, 1) WHEN 1 THEN t || '/' || b || '_x1' ELSE 'autoload:Outer::' || upper(t[1]) || t[2:] END
  ELSE CASE w WHEN 0 THEN 'crate::' || b || '::' || t || '::Name' WHEN 1 THEN 'super::' || b || '::*' ELSE 'mod:' || t END END AS source
  FROM (SELECT l_partkey, l_linenumber % 3 AS w, 'brand' || (l_orderkey % 25 + 1) AS b, ['economy', 'medium', 'promo', 'large', 'small', 'standard'][l_suppkey % 6 + 1] AS t, l_quantity::INT::VARCHAR AS q FROM lineitem)
  JOIN tree ON l_partkey = p_partkey)"""
# Sources of ../ and ./ as paths, for the three depths that the view has.
BASES = """bases AS (SELECT importer, source, CASE WHEN source LIKE './%' THEN own || source[2:] WHEN source LIKE '../../%' THEN regexp_replace(own, '/[^/]*/[^/]*$', '') || replace(source[6:], '/./', '/')
  ELSE regexp_replace(own, '/[^/]*$', '') || source[3:] END AS base FROM lines WHERE source LIKE '.%')"""


# Imports


@query(f"""WITH {TREE}, {LINES}, g AS (SELECT path, dir FROM files WHERE path LIKE '%.go'),
c AS (SELECT importer, source, own, i AS cut, array_to_string(string_split(source, '/')[i:], '/') AS tail FROM lines, range(1, 9) r(i) WHERE source LIKE '%/%' AND i <= len(string_split(source, '/')) AND importer LIKE '%.go'),
h AS (SELECT importer, source, cut, path AS file FROM c JOIN g ON (dir = tail OR ends_with(dir, '/' || tail)) AND dir <> own)
SELECT importer, source, file FROM h QUALIFY cut = min(cut) OVER (PARTITION BY importer, source)""")
def import_go(spark, sf_dir):
    lines = src.import_lines(spark, sf_dir).where("importer LIKE '%.go'")
    return imports.go(src.tree(spark, sf_dir), lines)


@query(f"""WITH {TREE}, {LINES}, {BASES}, c AS (SELECT importer, source, base, i, CASE WHEN i < 4 THEN base ELSE base || '/index' END || ['.ts', '.tsx', '.js', '.jsx'][i % 4 + 1] AS path FROM bases, range(8) r(i) WHERE importer LIKE 'web/%')
SELECT importer, source, path AS file FROM c JOIN files USING (path) QUALIFY i = min(i) OVER (PARTITION BY importer, source)""")
def import_script(spark, sf_dir):
    return imports.script(src.tree(spark, sf_dir), src.import_lines(spark, sf_dir).where("importer LIKE 'web/%'"))


@query(f"""WITH {TREE}, {LINES}, m AS (SELECT replace(regexp_replace(regexp_replace(path, '[.]py$', ''), '/__init__$', ''), '/', '.') AS name, path FROM files WHERE path LIKE '%.py'),
p AS (SELECT DISTINCT source FROM lines WHERE importer LIKE '%.py'), n AS (SELECT source, string_split(source, '.') AS parts FROM p),
c AS (SELECT source, 0 AS i, path FROM p JOIN m ON name = source UNION ALL SELECT source, 1, path FROM p JOIN files ON path = replace(source, '.', '/') || '.py'
  UNION ALL SELECT source, 2, path FROM p JOIN files ON path = replace(source, '.', '/') || '/__init__.py' UNION ALL SELECT source, 100 - k, path FROM n, range(1, 9) r(k) JOIN m ON name = array_to_string(parts[:k], '.') WHERE k <= len(parts)),
f AS (SELECT source, arg_min(path, i) AS file FROM c GROUP BY 1)
SELECT importer, source, file FROM lines JOIN f USING (source) WHERE importer LIKE '%.py'""")
def import_python(spark, sf_dir):
    return imports.python(src.tree(spark, sf_dir), src.import_lines(spark, sf_dir).where("importer LIKE '%.py'"))


@query(f"""WITH {TREE}, {LINES}, k AS (SELECT path, array_to_string(list_transform(string_split(regexp_extract(path, '^app/models/(.*)[.]rb$', 1), '/'), lambda s: array_to_string(list_transform(string_split(s, '_'), lambda w: upper(w[1]) || w[2:]), '')), '::') AS name FROM files WHERE path LIKE '%.rb'),
l AS (SELECT importer, source, CASE WHEN source LIKE 'autoload:%' THEN source[10:] END AS name FROM lines WHERE importer LIKE '%.rb'),
c AS (SELECT importer, source, 0 AS i, path FROM l JOIN k USING (name) UNION ALL SELECT importer, source, 1, path FROM l JOIN k ON k.name = regexp_extract(l.name, '::([^:]*)$', 1)
  UNION ALL SELECT importer, source, 2, path FROM l JOIN files ON path = 'app/models/' || source || '.rb' WHERE l.name IS NULL),
b AS (SELECT importer, source, i, path FROM c QUALIFY i = min(i) OVER (PARTITION BY importer, source)) SELECT importer, source, path AS file FROM b WHERE path <> importer OR source NOT LIKE 'autoload:%'""")
def import_ruby(spark, sf_dir):
    return imports.ruby(src.tree(spark, sf_dir), src.import_lines(spark, sf_dir).where("importer LIKE '%.rb'"))


@query(f"""WITH {TREE}, {LINES}, l AS (SELECT importer, source, own FROM lines WHERE importer LIKE '%.rs'),
c AS (SELECT importer, source, k * 2 + j AS i, 'core/src/' || array_to_string(string_split(source[8:], '::')[: 3 - k], '/') || ['.rs', '/mod.rs'][j + 1] AS path FROM l, range(3) r(k), range(2) s(j) WHERE source LIKE 'crate::%'
  UNION ALL SELECT importer, source, j, CASE WHEN importer LIKE '%/mod.rs' THEN own ELSE importer[:-4] END || '/' || source[5:] || ['.rs', '/mod.rs'][j + 1] FROM l, range(2) s(j) WHERE source LIKE 'mod:%'),
one AS (SELECT importer, source, path FROM c JOIN files USING (path) QUALIFY i = min(i) OVER (PARTITION BY importer, source))
SELECT importer, source, path AS file FROM one
UNION ALL SELECT importer, source, path FROM l JOIN files ON dir = 'core/src/' || string_split(source, '::')[2] WHERE source LIKE 'super::%' AND path LIKE '%.rs' AND path <> importer""")
def import_rust(spark, sf_dir):
    return imports.rust(src.tree(spark, sf_dir), src.import_lines(spark, sf_dir).where("importer LIKE '%.rs'"))


# Renames

FUNCTIONS = """before AS (SELECT conv_id AS path, 'turn' || turn AS name, coalesce(text, '') AS body FROM conversations),
after AS (SELECT conv_id AS path, CASE WHEN w = 2 THEN '' ELSE 'new' END || 'turn' || turn AS name, CASE w WHEN 0 THEN regexp_replace(b, '^[^ ]+ ', '') WHEN 1 THEN replace(b, 'e', 'é') ELSE b || '.' END AS body
  FROM (SELECT conv_id, turn, (conv_id + turn) % 5 AS w, coalesce(text, '') AS b FROM conversations) WHERE w < 4)"""


def functions(spark, sf_dir):
    """Two versions (path, name, body): turns of a conversation are functions of a file; some are renamed and edited, some go."""
    rows = src.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), "turn", F.coalesce("text", F.lit("")).alias("body"), ((F.col("conv_id") + F.col("turn")) % 5).alias("w"))
    name = F.concat(F.lit("turn"), F.col("turn").cast("string"))
    edited = F.when(F.col("w") == 0, F.regexp_replace("body", "^[^ ]+ ", "")).when(F.col("w") == 1, F.translate("body", "e", "é")).otherwise(F.concat("body", F.lit(".")))
    renamed = F.concat(F.when(F.col("w") == 2, "").otherwise("new"), name)
    return rows.select("path", name.alias("name"), "body"), rows.where("w < 4").select("path", renamed.alias("name"), edited.alias("body"))


@query(f"""WITH RECURSIVE {FUNCTIONS}, gone AS (SELECT * FROM before b WHERE body <> '' AND NOT EXISTS (SELECT 1 FROM after a WHERE a.path = b.path AND a.name = b.name)),
come AS (SELECT * FROM after a WHERE body <> '' AND NOT EXISTS (SELECT 1 FROM before b WHERE a.path = b.path AND a.name = b.name)),
p AS (SELECT path, g.name AS o, c.name AS n, round(1 - levenshtein(g.body, c.body) / greatest(strlen(g.body), strlen(c.body)), 6) AS s FROM gone g JOIN come c USING (path)),
k AS (SELECT path, o, n, s, row_number() OVER (PARTITION BY path ORDER BY s DESC, o, n) AS i FROM p WHERE s >= 0.7),
r AS (SELECT DISTINCT path, 0::BIGINT AS i, []::VARCHAR[] AS os, []::VARCHAR[] AS ns FROM k
  UNION ALL SELECT r.path, k.i, CASE WHEN taken THEN os ELSE list_append(os, o) END, CASE WHEN taken THEN ns ELSE list_append(ns, n) END
  FROM r JOIN k ON k.path = r.path AND k.i = r.i + 1, LATERAL (SELECT list_contains(os, o) OR list_contains(ns, n) AS taken)),
e AS (SELECT path, unnest(os) AS old_name, unnest(ns) AS new_name FROM r QUALIFY i = max(i) OVER (PARTITION BY path))
SELECT e.path, old_name, new_name, s AS similarity FROM e JOIN k ON k.path = e.path AND o = old_name AND n = new_name""")
def rename_candidates(spark, sf_dir):
    return renames.renamed(*functions(spark, sf_dir))


@query(f"""WITH {FUNCTIONS} SELECT b.path, b.name, levenshtein(b.body, a.body) AS distance,
  CASE WHEN b.body = a.body THEN 1.0 WHEN b.body = '' OR a.body = '' THEN 0.0 ELSE round(1 - levenshtein(b.body, a.body) / greatest(strlen(b.body), strlen(a.body)), 6) END::DOUBLE AS similarity
FROM before b JOIN after a ON a.path = b.path AND replace(a.name, 'new', '') = b.name""")
def byte_similarity(spark, sf_dir):
    before, after = functions(spark, sf_dir)
    both = before.join(after.select("path", F.regexp_replace("name", "new", "").alias("name"), F.col("body").alias("then")), ["path", "name"])
    return both.select("path", "name", renames.distance(F.col("body"), F.col("then")).alias("distance"), F.round(renames.similarity(F.col("body"), F.col("then")), 6).alias("similarity"))


# Configuration files

CONFIGS = """texts AS (SELECT l_orderkey AS id, l_linenumber AS n, l_quantity::INT AS q, l_suppkey % 7 AS s, l_partkey % 5 AS p FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1),
docs AS (SELECT id, n, '{"name":"pkg","limits":{"max":' || q || ',"burst.size":' || (q % 3) || CASE WHEN s > 2 THEN ',"deep":{"timeoutMs":' || s || CASE WHEN q % 4 = 0 THEN ',"enabled":true' ELSE '' END || '}' ELSE '' END || '},"tags":[1,' || p || ',{"k":' || CASE WHEN p = 1 THEN '1.0' ELSE '1' END || '}],'
  || '"retry":' || CASE p WHEN 0 THEN 'null' WHEN 1 THEN '"three"' WHEN 2 THEN '3' WHEN 3 THEN '3.0' ELSE '{"attempts":3}' END
  || ',"dependencies":{"left":"^' || s || '.2","right":"1.' || p || '"' || CASE WHEN q % 3 = 0 THEN ',"extra":"0.1"' ELSE '' END || '},"devDependencies":{"test":"~' || (q % 2) || '"' || CASE WHEN s = 0 THEN ',"odd":7' ELSE '' END || '}}' AS doc FROM texts),
versions AS (SELECT id, n, lag(doc) OVER (PARTITION BY id ORDER BY n) AS before, doc AS after FROM docs),
pairs AS MATERIALIZED (SELECT id, n, before::JSON AS before, after::JSON AS after FROM versions WHERE before IS NOT NULL)"""
# Differences of pairs, one level of keys after the other; numbers are compared as numbers inside of arrays, too, and arrays by all of their parts.
CHANGES = """kinds(raw, kind) AS (VALUES ('UBIGINT', 'number'), ('BIGINT', 'number'), ('DOUBLE', 'number'), ('VARCHAR', 'string'), ('BOOLEAN', 'boolean'), ('NULL', 'null'), ('OBJECT', 'object'), ('ARRAY', 'array')),
walk AS (SELECT id, n, '' AS path, before AS b, after AS a FROM pairs
  UNION ALL SELECT id, n, CASE WHEN path = '' THEN k ELSE path || '.' || k END, json_extract(b, '/' || k), json_extract(a, '/' || k) FROM (
    SELECT id, n, path, b, a, unnest(list_distinct(list_concat(json_keys(b), json_keys(a)))) AS k FROM walk WHERE json_type(b) = 'OBJECT' AND json_type(a) = 'OBJECT')),
seen AS (SELECT id, n, path, b, a, x.kind AS kb, y.kind AS ka FROM walk LEFT JOIN kinds x ON x.raw = json_type(b) LEFT JOIN kinds y ON y.raw = json_type(a)),
changes AS (SELECT id, n, path, CASE WHEN kb IS NULL THEN 'JSON_FIELD_ADDED' WHEN ka IS NULL THEN 'JSON_FIELD_REMOVED' WHEN kb <> ka THEN 'JSON_VALUE_CHANGED'
    WHEN kb = 'array' AND list_transform(['0', '1', '2/k'], lambda i: json_extract(b, '/' || i)::DOUBLE) <> list_transform(['0', '1', '2/k'], lambda i: json_extract(a, '/' || i)::DOUBLE) THEN 'JSON_ARRAY_CHANGED'
    WHEN kb = 'number' AND b::DOUBLE <> a::DOUBLE OR kb IN ('string', 'boolean') AND b::VARCHAR <> a::VARCHAR THEN 'JSON_VALUE_CHANGED' END AS category FROM seen)"""
DEPENDENCIES = """deps AS (SELECT id, n, section, key AS name, b ->> key AS old, a ->> key AS new FROM (SELECT id, n, section, json_extract(before, '/' || section) AS b, json_extract(after, '/' || section) AS a,
    unnest(list_distinct(list_concat(json_keys(before, '/' || section), json_keys(after, '/' || section)))) AS key FROM pairs, (VALUES ('dependencies'), ('devDependencies'), ('peerDependencies'), ('optionalDependencies')) t(section))),
strings AS (SELECT id, n, section, name, CASE WHEN name <> 'odd' THEN old END AS old, CASE WHEN name <> 'odd' THEN new END AS new FROM deps),
updates AS (SELECT id, n, section || '.' || name AS path, CASE WHEN old IS NULL THEN 'DEPENDENCY_ADDED' WHEN new IS NULL THEN 'DEPENDENCY_REMOVED' ELSE 'DEPENDENCY_UPDATED' END AS category, old, new,
  CASE WHEN new IS NULL OR old IS NOT NULL AND split_part(ltrim(old, '^~>=<'), '.', 1) <> split_part(ltrim(new, '^~>=<'), '.', 1) THEN 'config,breaking' ELSE 'config' END AS tags FROM strings WHERE old IS DISTINCT FROM new)"""


def config_pairs(spark, sf_dir):
    """id, n, before, after: the JSON texts of neighbouring lines of an order, made from the lines' numbers."""
    lines = src.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), "l_partkey", "l_suppkey", "l_quantity")
    one = lines.repartition("id").groupBy("id", "n").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("x"))  # an order's lines meet in the window anyway: one shuffle
    q, s, p = F.col("x.l_quantity").cast("int"), F.col("x.l_suppkey") % 7, F.col("x.l_partkey") % 5
    text = lambda c: c.cast("string")
    when = lambda c, *parts: F.when(c, F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))).otherwise("")
    deep = F.concat(F.lit(',"deep":{"timeoutMs":'), text(s), when(q % 4 == 0, ',"enabled":true'), F.lit("}"))
    retry = F.when(p == 0, "null").when(p == 1, '"three"').when(p == 2, "3").when(p == 3, "3.0").otherwise('{"attempts":3}')
    doc = F.concat(
        F.lit('{"name":"pkg","limits":{"max":'), text(q), F.lit(',"burst.size":'), text(q % 3), F.when(s > 2, deep).otherwise(""), F.lit('},"tags":[1,'), text(p), F.lit(',{"k":'), F.when(p == 1, "1.0").otherwise("1"),
        F.lit('}],"retry":'), retry, F.lit(',"dependencies":{"left":"^'), text(s), F.lit('.2","right":"1.'), text(p), F.lit('"'), when(q % 3 == 0, ',"extra":"0.1"'), F.lit('},"devDependencies":{"test":"~'),
        text(q % 2), F.lit('"'), when(s == 0, ',"odd":7'), F.lit("}}"),
    )
    before = F.lag("after").over(Window.partitionBy("id").orderBy("n"))
    return one.select("id", "n", doc.alias("after")).withColumn("before", before).where("before IS NOT NULL").select("id", "n", "before", "after")


@query(f"WITH RECURSIVE {CONFIGS}, {CHANGES} SELECT id, n, path, category FROM changes WHERE category IS NOT NULL")
def json_diff(spark, sf_dir):
    return configs.json_changes(config_pairs(spark, sf_dir), ["id", "n"])


@query(f"WITH {CONFIGS}, {DEPENDENCIES} SELECT * FROM updates")
def dependency_diff(spark, sf_dir):
    return configs.dependency_changes(config_pairs(spark, sf_dir), ["id", "n"]).withColumn("tags", F.array_join("tags", ","))


@query(f"""WITH RECURSIVE {CONFIGS}, {CHANGES}, {DEPENDENCIES} SELECT id, n, path, category FROM updates
UNION ALL SELECT id, n, path, category FROM changes c WHERE category IS NOT NULL AND NOT EXISTS (SELECT 1 FROM updates u WHERE u.id = c.id AND u.n = c.n AND (u.path = c.path OR starts_with(u.path, c.path || '.') OR starts_with(c.path, u.path || '.')))""")
def package_diff(spark, sf_dir):
    return configs.package_changes(config_pairs(spark, sf_dir), ["id", "n"])


@query(f"""WITH RECURSIVE {CONFIGS}, {CHANGES}, g AS (SELECT id, n, path, category, CASE WHEN regexp_matches(lower(path), 'enabled|disabled|feature|flag|toggle') THEN 'feature_flag' WHEN regexp_matches(lower(path), 'timeout|ttl|expire|duration') THEN 'timeout'
  WHEN regexp_matches(lower(path), 'limit|max|min|threshold|size|count') THEN 'limit' WHEN regexp_matches(lower(path), 'retry|attempt|backoff') THEN 'retry' WHEN regexp_matches(lower(path), 'url|host|port|endpoint') THEN 'endpoint'
  WHEN regexp_matches(lower(path), 'secret|key|token|password|credential') THEN 'credential' ELSE 'general' END AS key_category FROM changes WHERE category IS NOT NULL)
SELECT id, n, path, key_category, CASE WHEN category <> 'JSON_VALUE_CHANGED' THEN category ELSE CASE key_category WHEN 'feature_flag' THEN 'FEATURE_FLAG_CHANGED' WHEN 'timeout' THEN 'TIMEOUT_CHANGED' WHEN 'limit' THEN 'LIMIT_CHANGED'
  WHEN 'retry' THEN 'RETRY_CONFIG_CHANGED' WHEN 'endpoint' THEN 'ENDPOINT_CHANGED' WHEN 'credential' THEN 'CREDENTIAL_CHANGED' ELSE category END END AS category FROM g""")
def config_diff(spark, sf_dir):
    return configs.enriched(configs.json_changes(config_pairs(spark, sf_dir), ["id", "n"])).select("id", "n", "path", "key_category", "category")


# Test edges


@query(f"WITH RECURSIVE {EDGES}, c AS (SELECT src AS test, dst AS path FROM edges WHERE src LIKE 'tests/%' UNION SELECT test, dst FROM c JOIN edges ON src = path) SELECT test, path FROM c WHERE path NOT LIKE 'tests/%'")
def test_closure(spark, sf_dir):
    return graph.test_edges(src.edges(spark, sf_dir))


# Merges

MERGES = """sides AS (SELECT doc_id, coalesce(text, '') AS base, doc_id % 6 AS w FROM documents),
versions AS (SELECT doc_id, base, CASE WHEN w IN (0, 3) THEN base WHEN w = 4 THEN replace(base, chr(10), chr(10) || 'x') WHEN w = 5 THEN 'left' || base ELSE 'left' || chr(10) || base END AS "left",
  CASE w WHEN 1 THEN base WHEN 2 THEN base || 'right' WHEN 3 THEN base || chr(10) || 'more' WHEN 4 THEN base || chr(10) || 'end' WHEN 5 THEN 'right' || base ELSE base || '!' END AS "right" FROM sides)"""


def text_versions(spark, sf_dir):
    """doc_id, base, left, right: three versions of each document."""
    base, w = F.coalesce("text", F.lit("")), F.col("doc_id") % 6
    at = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    left = F.when(w.isin(0, 3), base).when(w == 4, F.replace(base, F.lit("\n"), F.lit("\nx"))).when(w == 5, at("left", base)).otherwise(at("left\n", base))
    right = F.when(w == 1, base).when(w == 2, at(base, "right")).when(w == 3, at(base, "\nmore")).when(w == 4, at(base, "\nend")).when(w == 5, at("right", base)).otherwise(at(base, "!"))
    return src.table(spark, sf_dir, "documents").select("doc_id", base.alias("base"), left.alias("left"), right.alias("right"))


# Lines with their ends are what stands between line feeds, each but the last with its own; equal beginnings and ends by the first place that differs.
@query(f"""WITH {MERGES}, parts AS (SELECT doc_id, base, "left", "right", [base, "left", "right"] AS t FROM versions),
p AS (SELECT doc_id, base, "left", "right", list_transform(t, lambda x: list_filter(list_transform(range(1, len(string_split(x, chr(10))) + 1), lambda i: string_split(x, chr(10))[i] || CASE WHEN i < len(string_split(x, chr(10))) THEN chr(10) ELSE '' END), lambda y: y <> '')) AS p FROM parts),
s AS (SELECT doc_id, base, "left", "right", p[1] AS b, p[k + 1] AS o, k FROM p, range(1, 3) r(k)),
f AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(b), len(o)) + 1), lambda i: b[i] = o[i]), false) - 1, least(len(b), len(o))) AS pre FROM s),
g AS (SELECT *, coalesce(list_position(list_transform(range(0, least(len(b), len(o)) - pre), lambda i: b[len(b) - i] = o[len(o) - i]), false) - 1, least(len(b), len(o)) - pre) AS suf FROM f),
h AS (SELECT doc_id, any_value(base) AS base, any_value("left") AS l, any_value("right") AS r, any_value(b) AS b, max({{'s': pre, 'e': len(b) - suf, 'new': o[pre + 1 : len(o) - suf]}}) FILTER (WHERE k = 1) AS hl, max({{'s': pre, 'e': len(b) - suf, 'new': o[pre + 1 : len(o) - suf]}}) FILTER (WHERE k = 2) AS hr FROM g GROUP BY doc_id),
d AS (SELECT *, CASE WHEN base = l THEN 'right' WHEN base = r OR l = r THEN 'left' WHEN hl.e <= hr.s THEN 'left then right' WHEN hr.e <= hl.s THEN 'right then left' ELSE 'conflict' END AS decision FROM h)
SELECT doc_id, decision, sha256(CASE decision WHEN 'right' THEN r WHEN 'left' THEN l
  WHEN 'left then right' THEN array_to_string(list_concat(b[:hl.s], hl.new, b[hl.e + 1 : hr.s], hr.new, b[hr.e + 1 :]), '') WHEN 'right then left' THEN array_to_string(list_concat(b[:hr.s], hr.new, b[hr.e + 1 : hl.s], hl.new, b[hl.e + 1 :]), '') END) AS merged_sha256 FROM d""")
def merge_text(spark, sf_dir):
    return merges.merged_texts(text_versions(spark, sf_dir)).select("doc_id", "decision", F.sha2("merged", 256).alias("merged_sha256"))


@query(f"""WITH {MERGES} SELECT doc_id, CASE WHEN "left" = "right" THEN 'skip' WHEN base = "left" THEN 'receive' WHEN base = "right" THEN 'push' WHEN doc_id % 6 IN (2, 4) THEN 'merge' ELSE 'conflict' END AS event FROM versions
WHERE doc_id % 6 <> 4 AND contains(base, chr(10)) AND length(string_split(base, chr(10))[1]) > 0 AND length(string_split(base, chr(10))[-1]) > 0""")
def sync_events(spark, sf_dir):
    rows = text_versions(spark, sf_dir).where("doc_id % 6 <> 4")
    lines = F.split("base", "\n")
    rows = rows.where(F.col("base").contains("\n") & (F.length(lines[0]) > 0) & (F.length(F.element_at(lines, -1)) > 0))
    return merges.sync_events(rows).select("doc_id", "event")


UNITS = """turns AS (SELECT conv_id AS path, turn AS key, ['function', 'class', 'const', 'import', 'type'][(conv_id + turn) % 5 + 1] AS kind, role AS signature, coalesce(text, '') AS content, (conv_id * 5 + turn * 3) % 11 AS x, (conv_id + turn * 2) % 7 AS y FROM conversations),
b AS (SELECT * FROM turns WHERE y <> 6),
l AS (SELECT path, key, kind, CASE WHEN x IN (1, 2, 9) THEN 'l' || signature ELSE signature END AS signature, CASE WHEN x BETWEEN 1 AND 5 OR x = 9 THEN content || 'left' ELSE content END AS content FROM turns WHERE x <> 7),
r AS (SELECT path, key, kind, CASE WHEN x IN (2, 3) OR y = 3 THEN 'r' || signature ELSE signature END AS signature, CASE WHEN x IN (2, 3, 4) OR y = 3 THEN content || 'right' ELSE content END AS content FROM turns WHERE x <> 8 AND x <> 9),
j AS (SELECT coalesce(b.path, l.path, r.path) AS path, coalesce(b.key, l.key, r.key) AS key, coalesce(b.kind, l.kind, r.kind) AS kind, b.content AS bc, l.content AS lc, r.content AS rc, b.signature AS bs, l.signature AS ls, r.signature AS rs
  FROM b FULL JOIN l ON b.path = l.path AND b.key = l.key FULL JOIN r ON coalesce(b.path, l.path) = r.path AND coalesce(b.key, l.key) = r.key),
u AS (SELECT *, CASE
  WHEN bc IS NULL THEN CASE WHEN lc <> rc THEN 'CONCURRENT_CREATE' END
  WHEN lc IS NULL THEN CASE WHEN rc <> bc THEN 'DELETE_vs_MODIFY' END
  WHEN rc IS NULL THEN CASE WHEN lc <> bc THEN 'MODIFY_vs_DELETE' END
  WHEN lc = bc OR rc = bc THEN NULL
  WHEN kind = 'function' THEN CASE WHEN ls <> bs AND rs <> bs AND ls <> rs THEN 'API_SIGNATURE_DIVERGED' WHEN (ls <> bs) <> (rs <> bs) THEN NULL WHEN lc <> rc THEN 'BODY_DIVERGED' END
  WHEN lc = rc THEN NULL WHEN kind = 'const' THEN 'CONST_VALUE_CONFLICT' WHEN kind = 'import' THEN 'IMPORT_ALIAS_CONFLICT' ELSE 'BODY_DIVERGED' END AS conflict FROM j),
m AS (SELECT *, CASE WHEN conflict IS NOT NULL THEN 'conflict' WHEN bc IS NULL THEN CASE WHEN lc IS NULL THEN 'right' ELSE 'left' END WHEN lc IS NULL OR rc IS NULL THEN 'deleted'
  WHEN lc = bc AND rc = bc THEN 'base' WHEN rc = bc THEN 'left' WHEN lc = bc THEN 'right' WHEN kind = 'function' AND rs <> bs AND ls = bs THEN 'right' ELSE 'left' END AS decision FROM u)"""


def unit_versions(spark, sf_dir):
    """base, left, right: turns are the units of a conversation; some are changed, signed anew, created or deleted on a side."""
    rows = src.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("path"), F.col("turn").alias("key"), F.get(F.array(*map(F.lit, ("function", "class", "const", "import", "type"))), ((F.col("conv_id") + F.col("turn")) % 5).cast("int")).alias("kind"),
        F.col("role").alias("signature"), F.coalesce("text", F.lit("")).alias("content"), F.col("turn").alias("line"), F.lit(0).alias("col"),
        ((F.col("conv_id") * 5 + F.col("turn") * 3) % 11).alias("x"), ((F.col("conv_id") + F.col("turn") * 2) % 7).alias("y"),
    )
    x, y = F.col("x"), F.col("y")
    add = lambda c, when, text: F.when(when, F.concat(c, F.lit(text))).otherwise(F.col(c))
    mark = lambda when, text: F.when(when, F.concat(F.lit(text), "signature")).otherwise(F.col("signature"))
    left = rows.where("x <> 7").withColumns({"signature": mark(x.isin(1, 2, 9), "l"), "content": add("content", x.between(1, 5) | (x == 9), "left")})
    right = rows.where("x <> 8 AND x <> 9").withColumns({"signature": mark(x.isin(2, 3) | (y == 3), "r"), "content": add("content", x.isin(2, 3, 4) | (y == 3), "right")})
    return rows.where("y <> 6"), left, right


@query(f"WITH {UNITS} SELECT path, key, kind, decision, conflict FROM m")
def merge_units(spark, sf_dir):
    return merges.merged_units(*unit_versions(spark, sf_dir)).drop("taken")


@query(f"""WITH {UNITS}, t AS (SELECT path, key, conflict, CASE decision WHEN 'base' THEN bc WHEN 'left' THEN lc WHEN 'right' THEN rc END AS content FROM m)
SELECT path, count(conflict) AS conflicts, CASE WHEN count(conflict) = 0 THEN sha256(coalesce(string_agg(content, chr(10) || chr(10) ORDER BY key), '') || chr(10)) END AS content_sha256 FROM t GROUP BY path""")
def merge_files(spark, sf_dir):
    files = merges.rebuilt_files(merges.merged_units(*unit_versions(spark, sf_dir)))
    return files.select("path", "conflicts", F.sha2("content", 256).alias("content_sha256"))


# Clusters of signals

CHANGE_SIGNALS = SIGNALS.replace("SELECT l_orderkey AS cluster,", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,") + """,
raw AS (SELECT l_orderkey % 50 AS change, l_orderkey * 10 + l_linenumber AS id, l_partkey AS p, category, confidence::DOUBLE AS confidence, tag, l_suppkey AS s, l_quantity AS q FROM signals
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, confidence) = 1),
sig AS (SELECT change, id, CASE WHEN p % 40 < 36 THEN 'm' || p % 40 % 6 ELSE 'General' END AS module, 'd' || p % 40 || '/f' || p % 200 || '.go' AS path, 'd' || p % 40 AS dir, category, confidence,
  CASE WHEN id % 2 = 1 THEN ['s' || s % 30, 't' || id % 9] ELSE [] END AS symbols, list_distinct(CASE WHEN q > 40 THEN [tag, 'api'] ELSE [tag] END) AS tags FROM raw),
imports AS (SELECT DISTINCT 'd' || p_partkey % 40 || '/f' || p_partkey % 200 || '.go' AS importer, 'd' || p_partkey * 7 % 40 || '/f' || p_partkey * 7 % 200 || '.go' AS file FROM part WHERE p_partkey % 9 = 0)"""


def change_signals(spark, sf_dir):
    """Signals of changes (orders in fifties), and imports of the files they stand in."""
    lines = src.signals(spark, sf_dir, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").withColumn("confidence", F.col("confidence").cast("double"))
    one = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "confidence", "category", "tag")).alias("x"))
    p, text = F.col("x.l_partkey"), lambda c: c.cast("string")
    file = lambda p: F.concat(F.lit("d"), text(p % 40), F.lit("/f"), text(p % 200), F.lit(".go"))
    code = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = one.select(
        (F.col("l_orderkey") % 50).alias("change"), code.alias("id"), F.when(p % 40 < 36, F.concat(F.lit("m"), text(p % 40 % 6))).alias("module"), file(p).alias("path"), "x.category", "x.confidence",
        F.when(code % 2 == 1, F.array(F.concat(F.lit("s"), text(F.col("x.l_suppkey") % 30)), F.concat(F.lit("t"), text(code % 9)))).otherwise(F.array().cast("array<string>")).alias("symbols"),
        F.when(F.col("x.l_quantity") > 40, F.array("x.tag", F.lit("api"))).otherwise(F.array("x.tag")).alias("tags"),
    )
    part = src.table(spark, sf_dir, "part").where("p_partkey % 9 = 0")
    return rows, part.select(file(F.col("p_partkey")).alias("importer"), file(F.col("p_partkey") * 7).alias("file"))


@query(f"""WITH RECURSIVE {CHANGE_SIGNALS}, fl AS MATERIALIZED (SELECT DISTINCT change, module, path, dir FROM sig),
e AS MATERIALIZED (SELECT a.change, a.module, a.path AS a, b.path AS b FROM fl a JOIN fl b ON a.change = b.change AND a.module = b.module AND (a.dir = b.dir OR (a.path, b.path) IN (SELECT (importer, file) FROM imports) OR (b.path, a.path) IN (SELECT (importer, file) FROM imports))),
w AS (SELECT change, module, path, path AS root FROM fl UNION SELECT e.change, e.module, e.b, w.root FROM w JOIN e ON e.change = w.change AND e.module = w.module AND e.a = w.path),
c AS (SELECT change, module, path, min(root) AS root FROM w GROUP BY ALL),
z AS (SELECT change, module, root, count(*) AS n FROM sig JOIN c USING (change, module, path) GROUP BY ALL),
h AS (SELECT change, module, root, CASE WHEN n > 1 THEN root ELSE coalesce(min(root) FILTER (WHERE n > 1) OVER (PARTITION BY change, module), min(root) OVER (PARTITION BY change, module)) END AS host FROM z),
m AS MATERIALIZED (SELECT sig.*, host, row_number() OVER (PARTITION BY sig.change, sig.module, host ORDER BY id) AS i FROM sig JOIN c USING (change, module, path) JOIN h ON h.change = sig.change AND h.module = sig.module AND h.root = c.root),
k AS (SELECT change, module, host, count(*) AS n, count(DISTINCT path) AS files, avg(confidence) AS conf FROM m GROUP BY ALL),
kc AS (SELECT change, module, host, max(x) AS most FROM (SELECT change, module, host, category, count(*) AS x FROM m GROUP BY ALL) GROUP BY ALL),
kt AS (SELECT change, module, host, max(x) AS most FROM (SELECT change, module, host, tag, count(*) AS x FROM (SELECT change, module, host, unnest(tags) AS tag FROM m) GROUP BY ALL) GROUP BY ALL),
loose AS MATERIALIZED (SELECT k.change, k.module, k.host FROM k JOIN kc USING (change, module, host) JOIN kt USING (change, module, host)
  WHERE n > 8 AND 0.3::DOUBLE * kc.most / n + 0.3::DOUBLE / files + 0.2::DOUBLE * kt.most / n + 0.2::DOUBLE * conf < 0.5),
lm AS MATERIALIZED (SELECT m.change, m.module, m.host, i, id, {{'id': id, 'path': path, 'category': category, 'symbols': symbols, 'tags': tags}} AS x FROM m JOIN loose USING (change, module, host)),
r AS (SELECT change, module, host, 1::BIGINT AS i, id, id AS seed, [x] AS seeds FROM lm WHERE i = 1
  UNION ALL SELECT change, module, host, i, id, coalesce(s.id, id), CASE WHEN s IS NULL THEN list_append(seeds, x) ELSE seeds END FROM (
    SELECT lm.change, lm.module, lm.host, lm.i, lm.id, lm.x, r.seeds, list_filter(r.seeds, lambda y: CASE WHEN y.path = lm.x.path THEN 0.4::DOUBLE ELSE 0 END
      + 0.3::DOUBLE * (len(list_intersect(y.symbols, lm.x.symbols)) / greatest(len(y.symbols), len(lm.x.symbols), 1)) + CASE WHEN y.category = lm.x.category THEN 0.2::DOUBLE ELSE 0 END
      + 0.1::DOUBLE * (len(list_intersect(y.tags, lm.x.tags)) / greatest(len(y.tags), len(lm.x.tags), 1)) > 0.3::DOUBLE)[1] AS s
    FROM r JOIN lm ON lm.change = r.change AND lm.module = r.module AND lm.host = r.host AND lm.i = r.i + 1))
SELECT m.change, m.id, m.module, m.host || CASE WHEN r.seed IS NULL THEN '' ELSE '#' || r.seed END AS cluster FROM m LEFT JOIN r ON r.change = m.change AND r.module = m.module AND r.host = m.host AND r.id = m.id""")
def change_clusters(spark, sf_dir):
    return clusters.clustered(*change_signals(spark, sf_dir))


# Symbols, conditions and constants


@query(f"""WITH {UNITS}, x AS (SELECT path, key, CASE kind WHEN 'const' THEN 'const' WHEN 'type' THEN 'variable' ELSE kind END AS kind, signature, content FROM b), z AS (SELECT path, key, CASE kind WHEN 'const' THEN 'const' WHEN 'type' THEN 'variable' ELSE kind END AS kind, signature, content FROM l),
d AS (SELECT coalesce(x.path, z.path) AS path, coalesce(x.key, z.key) AS name, CASE WHEN x.key IS NULL THEN 'added' WHEN z.key IS NULL THEN 'removed' WHEN x.signature <> z.signature OR z.kind IN ('const', 'variable') AND x.content <> z.content THEN 'modified' END AS action,
  CASE WHEN x.key IS NULL OR z.key IS NULL THEN NULL WHEN x.signature <> z.signature THEN 'API_SURFACE_CHANGED' WHEN z.kind IN ('const', 'variable') AND x.content <> z.content THEN 'CONSTANT_UPDATED' END AS change FROM x FULL JOIN z ON x.path = z.path AND x.key = z.key)
SELECT path, name, action, change FROM d WHERE action IS NOT NULL""")
def symbol_diff(spark, sf_dir):
    kind = F.when(F.col("kind") == "type", "variable").otherwise(F.col("kind"))
    base, left, _ = (df.select("path", F.col("key").alias("name"), kind.alias("kind"), "signature", F.col("content").alias("value")) for df in unit_versions(spark, sf_dir))
    return history.symbol_diff(base, left)


CONDITIONS = """n AS (SELECT l_partkey AS file, ['binary_expression', 'logical_expression', 'relational_expression'][l_suppkey % 3 + 1] AS type, l_orderkey * 10 + l_linenumber AS id, l_orderkey % 40 AS line, l_suppkey % 25 AS col,
  'v' || ['<', '<=', '>', '==', '&&'][l_linenumber % 5 + 1] || l_quantity::INT % 4 AS text, l_linestatus AS side FROM lineitem),
p AS (SELECT b.file, b.type, b.id AS before_id, a.id AS after_id, b.text AS old, a.text AS new, b.col AS c, a.col AS d FROM n b JOIN n a ON b.file = a.file AND b.type = a.type AND abs(b.line - a.line) <= 2 WHERE b.side = 'F' AND a.side = 'O' AND b.text <> a.text)"""


def conditions(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, ("binary_expression", "logical_expression", "relational_expression"))), (F.col("l_suppkey") % 3).cast("int"))
    text = F.concat(F.lit("v"), F.get(F.array(*map(F.lit, ("<", "<=", ">", "==", "&&"))), (F.col("l_linenumber") % 5).cast("int")), (F.col("l_quantity").cast("int") % 4).cast("string"))
    rows = src.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("file"), kind.alias("type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_orderkey") % 40).alias("line"), (F.col("l_suppkey") % 25).alias("col"), text.alias("text"), "l_linestatus"
    )
    return rows.where("l_linestatus = 'F'").drop("l_linestatus"), rows.where("l_linestatus = 'O'").drop("l_linestatus")


@query(f"WITH {CONDITIONS} SELECT file, type, before_id, after_id, old, new FROM p WHERE regexp_replace(old, '[^<>=&]', '', 'g') <> regexp_replace(new, '[^<>=&]', '', 'g') OR regexp_extract(old, '[0-9]+$') <> regexp_extract(new, '[0-9]+$')")
def condition_changes(spark, sf_dir):
    return history.condition_changes(*conditions(spark, sf_dir))


@query(f"WITH {CONDITIONS} SELECT file, type, before_id, after_id, old, new FROM p WHERE abs(c - d) <= 10")
def constant_updates(spark, sf_dir):
    return history.near_pairs(*conditions(spark, sf_dir), columns=10)
