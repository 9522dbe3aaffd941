"""Queries that resolve names, judge paths, choose tests and read coverage, with the DuckDB SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltaloom.operators import ignore, resolver, selection
from deltaloom.plans.registry import query
from deltaloom.sources import packs
from deltaloom.sources import tables as src

# Names

# Ids of thirteen neighbouring documents begin with the same eight digits, those of three with the same ten.
NODES = """nodes AS (SELECT doc_id, substr(md5((doc_id // 13)::VARCHAR), 1, 8) || substr(md5('x' || doc_id // 3), 1, 2) || substr(sha256(doc_id::VARCHAR), 11, 54) AS id, ['Snapshot', 'ChangeSet', 'Workspace'][doc_id % 3 + 1] AS kind FROM documents),
slugs AS (SELECT 'slug_' || doc_id AS slug, id FROM nodes WHERE doc_id % 10 = 3), refs AS (SELECT 'ref.' || doc_id AS name, id, kind FROM nodes WHERE doc_id % 10 IN (3, 4)),
inputs AS (SELECT CASE doc_id % 9 WHEN 0 THEN id WHEN 1 THEN upper(substr(id, 1, 8)) WHEN 2 THEN substr(id, 1, 10) WHEN 3 THEN substr(id, 1, 20) WHEN 4 THEN 'slug_' || doc_id WHEN 5 THEN 'ref.' || doc_id
    WHEN 6 THEN '@' || ['snap', 'cs', 'workspace'][doc_id % 3 + 1] || ':' || CASE WHEN doc_id % 2 = 0 THEN 'last' ELSE 'prev' END || CASE WHEN doc_id % 4 > 1 THEN '~' || doc_id % 7 ELSE '' END
    WHEN 7 THEN substr(id, 1, 7) ELSE replace(id, '0', 'f') END AS input, CASE WHEN doc_id % 4 = 1 THEN 'ChangeSet' END AS want FROM nodes)"""


def stored_nodes(spark, sf_dir):
    """nodes, slugs, refs, log, inputs."""
    doc, text = F.col("doc_id"), lambda c: c.cast("string")
    group = lambda n: F.floor(doc / n).cast("string")
    node = F.concat(F.substring(F.md5(group(13)), 1, 8), F.substring(F.md5(F.concat(F.lit("x"), group(3))), 1, 2), F.substring(F.sha2(text(doc), 256), 11, 54))
    pick = lambda *names: F.get(F.array(*map(F.lit, names)), (doc % 3).cast("int"))
    nodes = src.table(spark, sf_dir, "documents").select("doc_id", node.alias("id"), pick("Snapshot", "ChangeSet", "Workspace").alias("kind"))
    slugs = nodes.where("doc_id % 10 = 3").select(F.concat(F.lit("slug_"), text(doc)).alias("slug"), "id")
    refs = nodes.where("doc_id % 10 IN (3, 4)").select(F.concat(F.lit("ref."), text(doc)).alias("name"), "id", "kind")
    selector = F.concat(F.lit("@"), pick("snap", "cs", "workspace"), F.lit(":"), F.when(doc % 2 == 0, "last").otherwise("prev"), F.when(doc % 4 > 1, F.concat(F.lit("~"), text(doc % 7))).otherwise(""))
    cut = lambda n: F.substring("id", 1, n)
    ways = [F.col("id"), F.upper(cut(8)), cut(10), cut(20), F.concat(F.lit("slug_"), text(doc)), F.concat(F.lit("ref."), text(doc)), selector, cut(7), F.translate("id", "0", "f")]
    inputs = nodes.select(F.get(F.array(*ways), (doc % 9).cast("int")).alias("input"), F.when(doc % 4 == 1, "ChangeSet").alias("want"))
    return nodes.select("id", "kind"), slugs, refs, nodes.select("kind", doc.alias("seq"), "id"), inputs


@query(f"""WITH {NODES}, i AS (SELECT DISTINCT input, want FROM inputs),
h AS (SELECT input, want, 0 AS rank, CASE WHEN kind IS NULL THEN 'not_found' WHEN want IS NULL OR want = kind THEN 'found' ELSE 'wrong_kind' END AS status, 'id' AS via, lower(input) AS id, kind, []::VARCHAR[] AS candidates
    FROM i LEFT JOIN nodes ON id = lower(input) WHERE regexp_full_match(lower(input), '[0-9a-f]{{64}}')),
n AS (SELECT * FROM i WHERE input NOT IN (SELECT input FROM h)),
s AS (SELECT input, want, 1 AS rank, 'found' AS status, 'slug' AS via, nodes.id, kind, []::VARCHAR[] AS candidates FROM n JOIN slugs ON slug = input JOIN nodes ON nodes.id = slugs.id WHERE want IS NULL OR want = kind),
r AS (SELECT input, want, 2 AS rank, 'found' AS status, 'ref' AS via, id, kind, []::VARCHAR[] AS candidates FROM n JOIN refs ON name = input WHERE want IS NULL OR want = kind),
o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY doc_id DESC) AS nth FROM nodes),
a AS (SELECT input, want, 3 AS rank, 'found' AS status, 'selector' AS via, id, kind, []::VARCHAR[] AS candidates FROM n JOIN o
    ON kind = CASE split_part(input[2:], ':', 1) WHEN 'snap' THEN 'Snapshot' WHEN 'cs' THEN 'ChangeSet' ELSE 'Workspace' END AND nth = 1 + CASE WHEN contains(input, 'prev') THEN 1 ELSE 0 END + coalesce(try_cast(split_part(input, '~', 2) AS INT), 0) WHERE input LIKE '@%' AND (want IS NULL OR want = kind)),
p AS (SELECT input, want, list(id ORDER BY id) AS ids, list(kind ORDER BY id) AS kinds FROM n JOIN nodes ON starts_with(id, lower(input)) WHERE regexp_full_match(lower(input), '[0-9a-f]{{8,}}') AND (want IS NULL OR want = kind) GROUP BY 1, 2),
e AS (FROM h UNION ALL FROM s UNION ALL FROM r UNION ALL FROM a UNION ALL SELECT input, want, 4, CASE WHEN len(ids) = 1 THEN 'found' ELSE 'ambiguous' END, 'short id', CASE WHEN len(ids) = 1 THEN ids[1] END, CASE WHEN len(ids) = 1 THEN kinds[1] END, ids[1:10] FROM p),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY input, want ORDER BY rank, id) = 1)
SELECT i.input, i.want, coalesce(status, 'not_found') AS status, via, id, kind, array_to_string(coalesce(candidates, []), ',') AS candidates FROM i LEFT JOIN b ON i.input = b.input AND i.want IS NOT DISTINCT FROM b.want""")
def resolve_names(spark, sf_dir):
    nodes, slugs, refs, log, inputs = stored_nodes(spark, sf_dir)
    return resolver.resolved(inputs, nodes, slugs, refs, log).withColumn("candidates", F.array_join("candidates", ","))


# Ignored paths

LINES = ["# build", "economy/", "*.rs", "!mod.rs", "/svc/**/f1*.go", "index.{js,ts} @semantic-ignore", "!/web/brand1?/**", "brand[0-4]/promo", "", "py/*/__init__.py", "!brand2/promo"]


# The same rules by hand, the last one first.
@query("""WITH f AS (SELECT DISTINCT 'svc/' || b || '/' || t || '/f' || p_partkey || '.go' AS path FROM (SELECT *, replace(lower(p_brand), '#', '') AS b, lower(p_type) AS t FROM part)
  UNION SELECT 'web/' || b || '/' || t || CASE WHEN p_partkey % 2 = 0 THEN '/index.ts' ELSE '/m.tsx' END FROM (SELECT *, replace(lower(p_brand), '#', '') AS b, lower(p_type) AS t FROM part)
  UNION SELECT 'core/' || b || CASE WHEN p_partkey % 2 = 0 THEN '/mod.rs' ELSE '/' || t || '.rs' END FROM (SELECT *, replace(lower(p_brand), '#', '') AS b, lower(p_type) AS t FROM part)
  UNION SELECT 'py/' || t || '/__init__.py' FROM (SELECT *, lower(p_type) AS t FROM part)),
r AS (SELECT path, CASE WHEN path LIKE 'brand2/promo/%' THEN 11 WHEN regexp_matches(path, '^py/[^/]+/__init__[.]py$') THEN 10 WHEN regexp_matches(path, '^brand[0-4]/promo(/|$)') THEN 8 WHEN regexp_matches(path, '^web/brand1[^/](/|$)') THEN 7
  WHEN regexp_matches(path, '^svc/(.*/)?f1[^/]*[.]go(/|$)') THEN 5 WHEN regexp_matches(path, '(^|/)mod[.]rs$') THEN 4 WHEN regexp_matches(path, '[.]rs$') THEN 3 WHEN contains(path, '/economy/') THEN 2 ELSE 0 END AS rule,
  regexp_matches(path, '(^|/)index[.](js|ts)$') AND NOT regexp_matches(path, '^web/brand1[^/]/') AS noted FROM f)
SELECT path, rule, rule NOT IN (2, 3, 5, 8, 10) AS captured, rule NOT IN (2, 3, 5, 8, 10) AND NOT noted AS analysed FROM r""")
def ignored_paths(spark, sf_dir):
    brand, kind = F.lower(F.translate("p_brand", "#", "")), F.lower("p_type")
    key, even = F.col("p_partkey"), F.col("p_partkey") % 2 == 0
    at = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    paths = F.array(
        at("svc/", brand, "/", kind, "/f", key.cast("string"), ".go"), at("web/", brand, "/", kind, F.when(even, "/index.ts").otherwise("/m.tsx")),
        at("core/", brand, F.when(even, F.lit("/mod.rs")).otherwise(at("/", kind, ".rs"))), at("py/", kind, "/__init__.py"),
    )
    files = src.table(spark, sf_dir, "part").select(F.explode(paths).alias("path")).distinct()
    return ignore.judged(files, LINES)


# Expansion

# Parts are loaders in folders of their brand and type; suppliers have tests in folders of the same form, modules are every third brand.
LOADERS = """loaders AS (SELECT DISTINCT p_size % 5 AS change, 'src/' || replace(lower(p_brand), '#', '') || '/' || lower(p_type) || '/l' || p_partkey % 50 || '.js' AS path, p_partkey % 7 = 0 AS bounded, p_partkey % 11 = 0 AS allowlisted FROM part),
tests AS (SELECT DISTINCT 'src/brand' || (s_suppkey * 7 % 25 + 1) || '/' || ['economy', 'medium', 'promo', 'large'][s_suppkey % 4 + 1] || '/t' || s_suppkey % 90 || '.test.js' AS path FROM supplier),
modules AS (SELECT DISTINCT 'm' || b AS module, 'src/brand' || b AS prefix FROM range(1, 26) t(b) WHERE b % 3 = 0)"""


def loaders(spark, sf_dir):
    """imports, tests, modules."""
    text = lambda c: c.cast("string")
    at = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    key = F.col("p_partkey")
    path = at("src/", F.lower(F.translate("p_brand", "#", "")), "/", F.lower("p_type"), "/l", text(key % 50), ".js")
    imports = src.table(spark, sf_dir, "part").select((F.col("p_size") % 5).alias("change"), path.alias("path"), (key % 7 == 0).alias("bounded"), (key % 11 == 0).alias("allowlisted"))
    s = F.col("s_suppkey")
    kind = F.get(F.array(*map(F.lit, ("economy", "medium", "promo", "large"))), (s % 4).cast("int"))
    tests = src.table(spark, sf_dir, "supplier").select(at("src/brand", text(s * 7 % 25 + 1), "/", kind, "/t", text(s % 90), ".test.js").alias("path"))
    brands = spark.range(1, 26).where("id % 3 = 0")  # a fixed, short table of rules
    return imports, tests, brands.select(at("m", text(F.col("id"))).alias("module"), at("src/brand", text(F.col("id"))).alias("prefix"))


@query(f"""WITH {LOADERS}, o AS (SELECT DISTINCT change, path, regexp_replace(path, '/[^/]*$', '') AS dir FROM loaders WHERE NOT bounded AND NOT allowlisted),
a AS (SELECT path, (SELECT count(DISTINCT t.path) FROM tests t JOIN modules m ON starts_with(t.path, m.prefix || '/') WHERE starts_with(o.path, m.prefix || '/')) AS near,
  (SELECT count(*) FROM tests t WHERE regexp_replace(t.path, '/[^/]*$', '') = o.dir) AS package, (SELECT count(*) FROM tests) AS whole, change FROM o)
SELECT change, path, CASE WHEN near > 0 THEN 'nearest_module' WHEN package > 0 THEN 'package' ELSE 'full_suite' END AS strategy, CASE WHEN near > 0 THEN near WHEN package > 0 THEN package ELSE whole END AS tests FROM a""")
def import_expansion(spark, sf_dir):
    return selection.expanded(*loaders(spark, sf_dir))


@query(f"""WITH {LOADERS} SELECT change, count(*) AS detected, count_if(bounded) AS bounded, count_if(allowlisted) AS allowlisted, count_if(NOT bounded AND NOT allowlisted) AS unbounded FROM loaders GROUP BY 1""")
def import_telemetry(spark, sf_dir):
    rows = loaders(spark, sf_dir)[0].distinct()
    return rows.groupBy("change").agg(F.count("*").alias("detected"), F.count_if("bounded").alias("bounded"), F.count_if("allowlisted").alias("allowlisted"), F.count_if(~F.col("bounded") & ~F.col("allowlisted")).alias("unbounded"))


# Coverage

# Every order is a report of its lines in one of three formats, or broken; lines of code are numbered by suppliers, hits are quantities, zero for returned ones.
REPORTS = """lines AS (SELECT l_orderkey AS report, 'src/p' || l_partkey % 5 AS file, l_suppkey AS line, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity::BIGINT END AS hits FROM lineitem),
kept AS (SELECT *, CASE report % 4 WHEN 0 THEN 'nyc' WHEN 1 THEN 'coveragepy' WHEN 2 THEN 'jacoco' END AS format FROM lines)"""


def reports(spark, sf_dir):
    lines = src.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("report"), F.concat(F.lit("p"), (F.col("l_partkey") % 5).cast("string")).alias("file"), F.col("l_suppkey").cast("int").alias("line"), F.when(F.col("l_returnflag") == "R", 0).otherwise(F.col("l_quantity").cast("long")).alias("hits")
    )
    files = lines.groupBy("report", "file").agg(F.collect_list(F.struct("line", "hits")).alias("lines"))  # a file of one report
    nth = lambda i: i.cast("string")
    path = F.concat(F.lit("src/"), "file")
    places = F.map_from_arrays(F.transform("lines", lambda x, i: nth(i)), F.transform("lines", lambda x: F.struct(F.struct(x["line"].alias("line")).alias("start"))))
    hits = F.map_from_arrays(F.transform("lines", lambda x, i: nth(i)), F.transform("lines", lambda x: x["hits"]))
    whole = files.groupBy("report").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(path.alias("k"), F.struct(path.alias("path"), places.alias("statementMap"), hits.alias("s")).alias("v"))))).alias("nyc"),
        F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(path.alias("k"), F.struct(F.transform(F.filter("lines", lambda x: x["hits"] > 0), lambda x: x["line"]).alias("executed_lines")).alias("v")))).alias("files"))).alias("py"),
        F.array_join(F.collect_list(F.concat(F.lit('<sourcefile name="'), "file", F.lit('">'), F.array_join(F.transform("lines", lambda x: F.concat(F.lit('<line nr="'), x["line"].cast("string"), F.lit('" ci="'), x["hits"].cast("string"), F.lit('"/>'))), ""), F.lit("</sourcefile>"))), "").alias("xml"),
    )
    way = F.col("report") % 4
    name = F.when(way == 0, "coverage-final.json").when(way == 1, "coverage.json").when(way == 2, "coverage.xml").when(F.col("report") % 8 == 3, "notes.txt").otherwise("coverage-final.json")
    content = F.when(way == 0, F.col("nyc")).when(way == 1, F.col("py")).when(way == 2, F.concat(F.lit('<?xml version="1.0"?><!DOCTYPE report><report name="jacoco"><package name="src">'), "xml", F.lit("</package></report>"))).otherwise(F.lit("{broken"))
    return whole.select("report", name.alias("name"), content.alias("content"))


@query(f"""WITH {REPORTS} SELECT report, format, file AS path, line::INT AS line, max(CASE WHEN format = 'coveragepy' THEN 1 ELSE hits END)::BIGINT AS hits FROM kept WHERE format IS NOT NULL AND hits > 0 GROUP BY ALL""")
def coverage_ingest(spark, sf_dir):
    return selection.covered_lines(reports(spark, sf_dir))[0]


@query("SELECT DISTINCT l_orderkey AS report, CASE WHEN l_orderkey % 8 = 7 THEN 'nyc' END AS format FROM lineitem WHERE l_orderkey % 4 = 3")
def coverage_rejects(spark, sf_dir):
    return selection.covered_lines(reports(spark, sf_dir))[1]


# Objects


@query("""WITH c AS (SELECT DISTINCT coalesce(text, '') AS content FROM documents WHERE text IS NOT NULL UNION SELECT html FROM pages WHERE html IS NOT NULL)
SELECT sha256(content) AS digest, strlen(content)::BIGINT AS length, sha256(content) AS content_sha256 FROM c""")
def object_packs(spark, sf_dir):
    """Texts and pages written as packs, pages twice, and read back."""
    path = src.new_folder(spark)
    pages = src.table(spark, sf_dir, "pages").select(F.col("html").alias("content"))
    packs.stored(src.table(spark, sf_dir, "documents").select(F.col("text").alias("content")), path)
    packs.stored(pages, path)
    packs.stored(pages, path)
    return packs.objects(spark, path).select("digest", "length", F.sha2("content", 256).alias("content_sha256"))
