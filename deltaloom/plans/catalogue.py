"""All queries over the driver's tables, by name, and the DuckDB SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltaloom.functions import paths
from deltaloom.operators import activity, graph, history, records, signals
from deltaloom.plans.registry import query
from deltaloom.sources import tables as src

# The derived views of deltaloom.sources.tables, in SQL.
EDGES = """ord AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN 'tests/ord/' || o_orderkey || '.test' ELSE 'ord/' || o_orderkey END AS path FROM orders),
used AS (SELECT DISTINCT path, l_partkey FROM lineitem JOIN ord ON l_orderkey = o_orderkey),
edges AS (SELECT 'nation/' || n_nationkey AS src, 'IMPORTS' AS type, 'region/' || n_regionkey AS dst FROM nation
  UNION ALL SELECT 'cust/' || c_custkey, 'IMPORTS', 'nation/' || c_nationkey FROM customer
  UNION ALL SELECT 'supp/' || s_suppkey, 'IMPORTS', 'nation/' || s_nationkey FROM supplier
  UNION ALL SELECT DISTINCT 'supp/' || l_suppkey, 'IMPORTS', 'part/' || l_partkey FROM lineitem
  UNION ALL SELECT path, 'CALLS', 'cust/' || o_custkey FROM ord
  UNION ALL SELECT path, CASE WHEN path LIKE 'tests/%' THEN 'TESTS' ELSE 'CALLS' END, 'part/' || l_partkey FROM used)"""
VERSIONS = """docs AS (SELECT doc_id, lang, concat_ws('/', coalesce(lang, 'none'), coalesce(source, 'none'), doc_id) AS path, coalesce(text, '') AS text FROM documents),
base AS (SELECT doc_id, path, lang, text AS content, sha256(text) AS digest FROM docs WHERE doc_id % 10 <> 0),
head0 AS (SELECT doc_id, path, lang, CASE WHEN doc_id % 7 = 0 THEN text || chr(10) || 'last line' ELSE text END AS content FROM docs WHERE doc_id % 10 <> 1),
head AS (SELECT *, sha256(content) AS digest FROM head0)"""
RANGES = """ranges AS (SELECT l_partkey AS file, l_linenumber::BIGINT * 10 AS start_line, l_linenumber::BIGINT * 10 + l_quantity::BIGINT - 1 AS end_line,
  CASE WHEN l_returnflag = 'R' THEN 'human' ELSE 'ai' END AS author_type, CASE WHEN l_returnflag = 'R' THEN '' ELSE l_suppkey::VARCHAR END AS agent,
  l_shipdate AS ts, l_orderkey * 10 + l_linenumber AS seq, l_returnflag FROM lineitem)"""
SIGNALS = """signals AS (SELECT l_orderkey AS cluster, ['FUNCTION_RENAMED','API_SURFACE_CHANGED','PARAMETER_ADDED','PARAMETER_REMOVED','FUNCTION_ADDED','FUNCTION_REMOVED','DEPENDENCY_ADDED','DEPENDENCY_REMOVED','DEPENDENCY_UPDATED',
  'FUNCTION_BODY_CHANGED','IMPORT_ADDED','IMPORT_REMOVED','CONDITION_CHANGED','CONSTANT_UPDATED','FEATURE_FLAG_CHANGED','CREDENTIAL_CHANGED','ENDPOINT_CHANGED','TIMEOUT_CHANGED','LIMIT_CHANGED','RETRY_CONFIG_CHANGED',
  'SCHEMA_FIELD_ADDED','SCHEMA_FIELD_REMOVED','SCHEMA_FIELD_CHANGED','MIGRATION_ADDED','JSON_FIELD_ADDED','JSON_FIELD_REMOVED','JSON_VALUE_CHANGED','JSON_ARRAY_CHANGED','YAML_KEY_ADDED','YAML_KEY_REMOVED','YAML_VALUE_CHANGED',
  'FILE_ADDED','FILE_DELETED','FILE_CONTENT_CHANGED','OTHER'][(l_orderkey * 3 + l_linenumber // 3) % 35 + 1] AS category,
  round(1 - l_discount, 2)::DECIMAL(6,2) AS confidence, ['breaking', 'api', 'config', 'test', 'security'][l_suppkey % 5 + 1] AS tag,
  'part/' || l_partkey || CASE WHEN l_partkey % 11 = 0 THEN '.md' ELSE '.go' END AS path, CASE WHEN l_quantity > 40 THEN 1.05 WHEN l_quantity > 25 THEN 1.03 ELSE 1.0 END::DOUBLE AS enriched FROM lineitem)"""


# Graph


@query(f"WITH RECURSIVE {EDGES}, hops AS (SELECT 'region/0' AS path, 0 AS hop UNION SELECT e.src, h.hop + 1 FROM hops h JOIN edges e ON e.dst = h.path WHERE h.hop < 3 AND e.type IN ('IMPORTS', 'CALLS'))\n"
       "SELECT path, min(hop) AS hop, starts_with(path, 'tests/') AS is_test FROM hops GROUP BY path HAVING min(hop) > 0")  # fmt: skip
def impact_khop(spark, sf_dir):
    return graph.impact(src.edges(spark, sf_dir), spark.createDataFrame([("region/0",)], "path string"))


@query(f"WITH {EDGES} SELECT dst AS path, count(DISTINCT src) AS n_dependents FROM edges WHERE type <> 'TESTS' GROUP BY 1")
def dependents(spark, sf_dir):
    return graph.dependants(src.edges(spark, sf_dir))


@query(f"WITH {EDGES} SELECT src AS path, count(DISTINCT dst) AS n_dependencies FROM edges WHERE type <> 'TESTS' GROUP BY 1")
def dependencies(spark, sf_dir):
    return graph.dependencies(src.edges(spark, sf_dir))


@query(f"WITH {EDGES}, r AS (SELECT src AS path, dst AS other FROM edges UNION SELECT dst, src FROM edges) SELECT path, count(*) AS n_related FROM r GROUP BY 1")
def related_1hop(spark, sf_dir):
    return graph.related(src.edges(spark, sf_dir)).groupBy("path").agg(F.count("*").alias("n_related"))


@query(f"WITH {EDGES}, s AS (SELECT DISTINCT dst AS path, 'dependents' AS side, src AS name FROM edges WHERE type <> 'TESTS' UNION ALL SELECT DISTINCT src, 'dependencies', dst FROM edges WHERE type <> 'TESTS'), n AS (SELECT *, row_number() OVER (PARTITION BY path, side ORDER BY name) AS nth FROM s)\n"
       "SELECT path, side, count(*) AS total, string_agg(name, ',' ORDER BY name) FILTER (WHERE nth <= 15) AS shown FROM n GROUP BY 1, 2")  # fmt: skip
def context_bundle(spark, sf_dir):
    return graph.context(src.edges(spark, sf_dir))


CHANGED = "changed AS (SELECT 'region/' || n_regionkey AS change, 'nation/' || n_nationkey AS path FROM nation UNION ALL SELECT 'brand/' || p_brand, 'part/' || p_partkey FROM part)"


def changed_files(spark, sf_dir):
    nation = src.table(spark, sf_dir, "nation").select(src.named("region/", "n_regionkey").alias("change"), src.named("nation/", "n_nationkey").alias("path"))
    return nation.unionByName(src.table(spark, sf_dir, "part").select(src.named("brand/", "p_brand").alias("change"), src.named("part/", "p_partkey").alias("path")))


@query(f"WITH {EDGES}, {CHANGED}, c AS (SELECT DISTINCT change, src FROM changed JOIN edges ON dst = path WHERE type <> 'TESTS'), r AS (SELECT change, count(*) AS n FROM c WHERE NOT EXISTS (SELECT 1 FROM changed d WHERE d.change = c.change AND d.path = c.src) GROUP BY 1),\n"
       "g AS (SELECT change, bool_or(path = 'nation/7' OR path LIKE 'part/99%') AS guarded FROM changed GROUP BY 1)\n"
       "SELECT change, coalesce(n, 0) AS radius, guarded, CASE WHEN guarded OR coalesce(n, 0) >= 400 THEN 'block' WHEN coalesce(n, 0) <= 100 THEN 'auto' ELSE 'review' END AS verdict FROM g LEFT JOIN r USING (change)")  # fmt: skip
def blast_radius_gate(spark, sf_dir):
    return graph.blast_radius(src.edges(spark, sf_dir), changed_files(spark, sf_dir), ["nation/7", "part/99*"], auto=100, block=400)


@query(f"WITH {EDGES}, {CHANGED} SELECT DISTINCT change, src AS test FROM changed JOIN edges ON dst = path WHERE type = 'TESTS' OR src LIKE 'tests/%'")
def affected_tests(spark, sf_dir):
    return graph.affected_tests(src.edges(spark, sf_dir), changed_files(spark, sf_dir))


@query(f"WITH RECURSIVE {EDGES}, roots AS (SELECT path FROM orders JOIN ord USING (o_orderkey) WHERE o_orderstatus = 'F'), seen AS (SELECT path FROM roots UNION SELECT e.dst FROM seen s JOIN edges e ON e.src = s.path),\n"
       "nodes AS (SELECT src AS path FROM edges UNION SELECT dst FROM edges) SELECT regexp_extract(path, '^(tests/)?([a-z]+)', 2) AS kind, count(*) AS n FROM nodes WHERE path NOT IN (SELECT path FROM seen) GROUP BY 1")  # fmt: skip
def gc_unreachable(spark, sf_dir):
    edges = src.edges(spark, sf_dir)
    roots = src.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(src.order_path().alias("path"))
    nodes = edges.select(F.col("src").alias("path")).unionByName(edges.select(F.col("dst").alias("path"))).distinct()
    lost = graph.unreachable(nodes, edges, roots)
    return lost.groupBy(F.regexp_extract("path", "^(tests/)?([a-z]+)", 2).alias("kind")).agg(F.count("*").alias("n"))


@query("WITH RECURSIVE p AS (SELECT 'cust/' || c_custkey AS a, 'nation/' || c_nationkey AS b FROM customer UNION SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),\n"
       "r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node) SELECT node, min(root) AS root FROM r GROUP BY 1")  # fmt: skip
def components(spark, sf_dir):
    customer, nation = src.table(spark, sf_dir, "customer"), src.table(spark, sf_dir, "nation")
    pairs = customer.select(src.named("cust/", "c_custkey").alias("a"), src.named("nation/", "c_nationkey").alias("b"))
    return graph.components(pairs.unionByName(nation.select(src.named("nation/", "n_nationkey").alias("a"), src.named("region/", "n_regionkey").alias("b"))))


# Edges as stored: duplicates, deltas


def stored_edges(spark, sf_dir):
    lines = src.table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_suppkey").alias("src"), F.lit("IMPORTS").alias("type"), F.col("l_partkey").alias("dst"), F.col("l_shipdate").alias("created_at"), F.col("l_orderkey").alias("at"), "l_linestatus")


@query("WITH g AS (SELECT l_suppkey AS src, 'IMPORTS' AS type, l_partkey AS dst, max({'t': l_shipdate, 'at': l_orderkey}) AS x, count(*) AS copies FROM lineitem GROUP BY ALL) SELECT src, type, dst, x.t AS created_at, x.at AS at, copies FROM g")
def edge_dedup(spark, sf_dir):
    return history.deduplicated(stored_edges(spark, sf_dir))


@query("SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def edge_dup_check(spark, sf_dir):
    return history.deduplicated(stored_edges(spark, sf_dir)).where("copies > 1").select("src", "dst", "copies")


@query("WITH o AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_linestatus = 'F'), n AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_linestatus <> 'F')\n"
       "SELECT src, dst, 'added' AS side FROM (FROM n EXCEPT FROM o) UNION ALL SELECT src, dst, 'removed' FROM (FROM o EXCEPT FROM n)")  # fmt: skip
def edge_delta(spark, sf_dir):
    edges = stored_edges(spark, sf_dir)
    return history.delta(edges.where("l_linestatus = 'F'"), edges.where("l_linestatus <> 'F'"), ["src", "dst"])


# Refs and ordinals


def refs(spark, sf_dir):
    return src.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("target"), F.col("o_orderdate").alias("moved_at"))


@query("SELECT name, target, moved_at FROM (SELECT o_custkey AS name, o_orderkey AS target, o_orderdate AS moved_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def upsert_latest(spark, sf_dir):
    return history.latest(refs(spark, sf_dir), ["name"], ["moved_at", "target"])


@query("SELECT name, target, moved_at FROM (SELECT o_custkey AS name, o_orderkey AS target, o_orderdate AS moved_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 3")
def nth_latest(spark, sf_dir):
    return history.latest(refs(spark, sf_dir), ["name"], ["moved_at", "target"], nth=3)


@query("SELECT o_custkey AS name, o_orderkey AS target, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS old_target, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq FROM orders")
def ref_history(spark, sf_dir):
    by = history.W.partitionBy("name").orderBy("moved_at", "target")
    return refs(spark, sf_dir).select("name", "target", F.lag("target").over(by).alias("old_target"), F.row_number().over(by).cast("long").alias("seq"))


@query("SELECT p_brand || '-' || row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS slug, p_partkey AS target FROM part")
def slug_sequence(spark, sf_dir):
    rows = records.packed(src.table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.lit(1).alias("one")), "p_brand", "p_partkey", "one")
    return rows.select(F.concat_ws("-", "p_brand", (F.col("offset") + 1).cast("string")).alias("slug"), F.col("p_partkey").alias("target"))


# Snapshots and merges


@query(f"WITH {VERSIONS} SELECT path, CASE WHEN b.digest IS NULL THEN 'added' WHEN h.digest IS NULL THEN 'deleted' WHEN b.digest <> h.digest THEN 'modified' ELSE 'same' END AS status FROM base b FULL JOIN head h USING (path)")
def snapshot_status(spark, sf_dir):
    return history.status(*src.versions(spark, sf_dir))


@query(f"WITH {VERSIONS} SELECT split_part(path, '/', 1) AS lang, count(*) FILTER (WHERE b.digest IS NULL) AS added, count(*) FILTER (WHERE h.digest IS NULL) AS deleted, count(*) FILTER (WHERE b.digest <> h.digest) AS modified FROM base b FULL JOIN head h USING (path) GROUP BY 1")
def snapshot_summary(spark, sf_dir):
    rows = history.status(*src.versions(spark, sf_dir))
    return rows.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("lang")).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("added", "deleted", "modified")))


@query(f"WITH {VERSIONS} SELECT DISTINCT digest FROM base WHERE digest NOT IN (SELECT digest FROM head)")
def negotiate_missing(spark, sf_dir):
    base, head = src.versions(spark, sf_dir)
    return base.select("digest").join(head.select("digest"), "digest", "left_anti").distinct()


@query(f"WITH {VERSIONS} SELECT digest, min(doc_id) AS first_id, count(*) AS copies FROM base GROUP BY 1")
def object_dedup(spark, sf_dir):
    return src.versions(spark, sf_dir)[0].groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@query(f"WITH {VERSIONS}, l AS (SELECT path, digest FROM head), r AS (SELECT path, sha256(CASE WHEN doc_id % 21 = 0 THEN content || 'x' ELSE content END) AS digest FROM base WHERE doc_id % 14 <> 1),\n"
       "m AS (SELECT path, b.digest AS o, l.digest AS l, r.digest AS r FROM base b FULL JOIN l USING (path) FULL JOIN r USING (path)), d AS (SELECT *, CASE WHEN l IS NOT DISTINCT FROM r THEN 'same' WHEN l IS NOT DISTINCT FROM o THEN 'right' WHEN r IS NOT DISTINCT FROM o THEN 'left' ELSE 'conflict' END AS decision FROM m)\n"
       "SELECT path, decision, CASE WHEN decision = 'conflict' THEN CASE WHEN o IS NULL THEN 'CONCURRENT_CREATE' WHEN l IS NULL THEN 'DELETE_vs_MODIFY' WHEN r IS NULL THEN 'MODIFY_vs_DELETE' ELSE 'BODY_DIVERGED' END END AS conflict FROM d")  # fmt: skip
def merge3_decisions(spark, sf_dir):
    base, head = src.versions(spark, sf_dir)
    other = F.when(F.col("doc_id") % 21 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content"))
    right = base.where("doc_id % 14 <> 1").select("path", F.sha2(other, 256).alias("digest"))
    return history.merged(base, head, right, ["path"])


UNITS = "u AS (SELECT path, unnest(string_split(content, chr(10))) AS body, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS unit FROM base), v AS (SELECT path, unnest(string_split(content, chr(10))) AS body, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS unit FROM head)"


@query(f"WITH {VERSIONS}, {UNITS} SELECT path, count(*) FILTER (WHERE u.body IS NULL) AS added, count(*) FILTER (WHERE v.body IS NULL) AS removed, count(*) FILTER (WHERE u.body <> v.body) AS modified FROM u FULL JOIN v USING (path, unit) GROUP BY 1")
def unit_diff(spark, sf_dir):
    units = lambda rows: rows.select("path", F.posexplode(F.split("content", "\n")).alias("unit", "body"))
    return history.unit_diff(*map(units, src.versions(spark, sf_dir)))


@query(f"WITH {VERSIONS}, p AS (SELECT path, string_split(b.content, chr(10)) AS a, string_split(h.content, chr(10)) AS z FROM base b JOIN head h USING (path) WHERE b.content <> h.content),\n"
       "q AS (SELECT *, (SELECT coalesce(min(i) - 1, least(len(a), len(z))) FROM range(1, least(len(a), len(z)) + 1) r(i) WHERE a[i] <> z[i]) AS prefix FROM p),\n"
       "s AS (SELECT *, least(len(a), len(z)) - prefix AS rest FROM q), t AS (SELECT *, (SELECT coalesce(min(i) - 1, rest) FROM range(1, rest + 1) r(i) WHERE a[len(a) + 1 - i] <> z[len(z) + 1 - i]) AS suffix FROM s)\n"
       "SELECT path, prefix, len(a) - suffix AS old_end, len(z) - suffix AS new_end FROM t")  # fmt: skip
def line_diff_range(spark, sf_dir):
    return history.changed_lines(*src.versions(spark, sf_dir))


@query(f"WITH {VERSIONS}, w AS (SELECT path, list_distinct(regexp_extract_all(b.content, '[A-Za-z]+')) AS a, list_distinct(regexp_extract_all(h.content, '[A-Za-z]+')) AS z FROM base b JOIN head h USING (path))\n"
       "SELECT path, len(list_intersect(a, z)) AS both, len(a) + len(z) - len(list_intersect(a, z)) AS either FROM w")  # fmt: skip
def token_jaccard(spark, sf_dir):
    base, head = src.versions(spark, sf_dir)
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0)))
    both = base.select("path", words(F.col("content")).alias("a")).join(head.select("path", words(F.col("content")).alias("z")), "path")
    return both.select("path", F.size(F.array_intersect("a", "z")).cast("long").alias("both"), F.size(F.array_union("a", "z")).cast("long").alias("either"))


# Authorship


OWNED = "sum(end_line - start_line + 1)::BIGINT AS total_lines, coalesce(sum(end_line - start_line + 1) FILTER (WHERE author_type = 'ai'), 0)::BIGINT AS ai_lines, coalesce(sum(end_line - start_line + 1) FILTER (WHERE author_type <> 'ai'), 0)::BIGINT AS human_lines, count(DISTINCT agent) FILTER (WHERE author_type = 'ai') AS agents"


@query(f"WITH {RANGES} SELECT file, {OWNED} FROM ranges GROUP BY 1")
def blame_summary(spark, sf_dir):
    return history.lines_owned(src.authorship(spark, sf_dir), ["file"])


@query(f"WITH {RANGES} SELECT CASE WHEN author_type = 'ai' THEN agent ELSE 'human' END AS who, {OWNED} FROM ranges GROUP BY 1")
def project_authorship(spark, sf_dir):
    who = F.when(F.col("author_type") == "ai", F.col("agent")).otherwise("human")
    return history.lines_owned(src.authorship(spark, sf_dir).withColumn("who", who), ["who"])


@query(f"WITH {RANGES}, l AS (SELECT *, unnest(range(start_line, end_line + 1)) AS line FROM ranges), w AS (SELECT file, line, author_type, agent FROM l QUALIFY row_number() OVER (PARTITION BY file, line ORDER BY ts DESC, seq DESC, author_type DESC, agent DESC) = 1),\n"
       "i AS (SELECT *, line - row_number() OVER (PARTITION BY file, author_type, agent ORDER BY line) AS run FROM w) SELECT file, author_type, agent, min(line) AS start_line, max(line) AS end_line FROM i GROUP BY file, author_type, agent, run")  # fmt: skip
def authorship_islands(spark, sf_dir):
    return history.consolidated(src.authorship(spark, sf_dir))


@query(f"WITH {RANGES} SELECT file, start_line, end_line, author_type, agent, seq FROM ranges o WHERE l_returnflag = 'N' AND NOT EXISTS (SELECT 1 FROM ranges n WHERE n.l_returnflag <> 'N' AND n.file = o.file AND n.start_line <= o.end_line AND n.end_line >= o.start_line)")
def authorship_forward_port(spark, sf_dir):
    rows = src.authorship(spark, sf_dir)
    kept = history.not_overlapping(rows.where("l_returnflag = 'N'"), rows.where("l_returnflag <> 'N'"))
    return kept.select("file", "start_line", "end_line", "author_type", "agent", "seq")


@query("WITH r AS (SELECT l_partkey AS key, l_orderkey * 10 + l_linenumber AS id, l_quantity::INT AS at FROM lineitem) SELECT a.key, a.id, b.id AS other FROM r a JOIN r b ON a.key = b.key AND a.id < b.id AND abs(a.at - b.at) <= 2")
def band_condition(spark, sf_dir):
    rows = src.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").cast("int").alias("at"))
    return history.band_pairs(rows, 2)


# Signals


@query(f"""WITH {SIGNALS} SELECT category, count(*) AS n, CASE
  WHEN category IN ('FUNCTION_RENAMED', 'API_SURFACE_CHANGED', 'MIGRATION_ADDED') THEN 0.9
  WHEN category IN ('PARAMETER_ADDED', 'PARAMETER_REMOVED', 'CREDENTIAL_CHANGED', 'SCHEMA_FIELD_REMOVED') THEN 0.85
  WHEN category IN ('FUNCTION_ADDED', 'FUNCTION_REMOVED', 'SCHEMA_FIELD_ADDED', 'SCHEMA_FIELD_CHANGED') THEN 0.8
  WHEN category IN ('DEPENDENCY_ADDED', 'DEPENDENCY_REMOVED') THEN 0.75 WHEN category IN ('DEPENDENCY_UPDATED', 'FEATURE_FLAG_CHANGED') THEN 0.7
  WHEN category IN ('FUNCTION_BODY_CHANGED', 'ENDPOINT_CHANGED') THEN 0.6 WHEN category IN ('TIMEOUT_CHANGED', 'LIMIT_CHANGED') THEN 0.55
  WHEN category IN ('IMPORT_ADDED', 'IMPORT_REMOVED', 'CONDITION_CHANGED', 'RETRY_CONFIG_CHANGED', 'FILE_ADDED', 'FILE_DELETED') THEN 0.5 WHEN category = 'CONSTANT_UPDATED' THEN 0.4
  WHEN category IN ('JSON_FIELD_ADDED', 'JSON_FIELD_REMOVED', 'YAML_KEY_ADDED', 'YAML_KEY_REMOVED') THEN 0.3 WHEN category IN ('JSON_VALUE_CHANGED', 'JSON_ARRAY_CHANGED', 'YAML_VALUE_CHANGED') THEN 0.2
  ELSE 0.1 END::DOUBLE AS weight FROM signals GROUP BY 1""")
def signal_weights(spark, sf_dir):
    return signals.weighted(src.signals(spark, sf_dir))


COHESION = """c AS (SELECT cluster, max(n) AS cat FROM (SELECT cluster, category, count(*) AS n FROM signals GROUP BY 1, 2) GROUP BY 1), t AS (SELECT cluster, max(n) AS top FROM (SELECT cluster, tag, count(*) AS n FROM signals GROUP BY 1, 2) GROUP BY 1),
w AS (SELECT cluster, count(*) AS n, count(DISTINCT path) AS files, sum(confidence)::DOUBLE AS c FROM signals GROUP BY 1),
cohesion AS (SELECT cluster, n, (CASE WHEN n <= 1 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 0.3::DOUBLE * cat / n + 0.3::DOUBLE / greatest(1, files) + 0.2::DOUBLE * top / n + 0.2::DOUBLE * w.c / n) END) AS cohesion FROM w JOIN c USING (cluster) JOIN t USING (cluster))"""
KINDS = """f AS (SELECT cluster, count(DISTINCT category) AS kinds, bool_or(tag = 'test') AS test, bool_or(tag = 'config') AS conf, bool_or(path LIKE '%.md') AS doc,
  bool_or(category IN ('FUNCTION_ADDED', 'FILE_ADDED', 'DEPENDENCY_ADDED', 'IMPORT_ADDED')) AS adds, bool_or(category IN ('FUNCTION_REMOVED', 'FILE_DELETED', 'DEPENDENCY_REMOVED', 'IMPORT_REMOVED')) AS removes,
  bool_or(category IN ('FUNCTION_BODY_CHANGED', 'FUNCTION_RENAMED', 'CONDITION_CHANGED', 'CONSTANT_UPDATED')) AS changes,
  bool_or(category IN ('JSON_VALUE_CHANGED', 'JSON_FIELD_ADDED', 'JSON_FIELD_REMOVED', 'YAML_VALUE_CHANGED', 'YAML_KEY_ADDED', 'YAML_KEY_REMOVED', 'FEATURE_FLAG_CHANGED', 'TIMEOUT_CHANGED', 'LIMIT_CHANGED', 'RETRY_CONFIG_CHANGED', 'ENDPOINT_CHANGED', 'CREDENTIAL_CHANGED')) AS config,
  bool_or(category NOT IN ('JSON_VALUE_CHANGED', 'JSON_FIELD_ADDED', 'JSON_FIELD_REMOVED', 'YAML_VALUE_CHANGED', 'YAML_KEY_ADDED', 'YAML_KEY_REMOVED', 'FEATURE_FLAG_CHANGED', 'TIMEOUT_CHANGED', 'LIMIT_CHANGED', 'RETRY_CONFIG_CHANGED', 'ENDPOINT_CHANGED', 'CREDENTIAL_CHANGED')) AS other
  FROM signals GROUP BY 1),
kinds AS (SELECT cluster, kinds, CASE WHEN test AND NOT adds AND NOT removes THEN 'test' WHEN doc AND NOT adds AND NOT removes THEN 'docs' WHEN conf AND NOT adds AND NOT removes THEN 'config'
  WHEN adds AND removes THEN 'refactor' WHEN adds AND NOT changes THEN 'feature' WHEN changes AND NOT adds AND NOT removes THEN 'bugfix' ELSE 'mixed' END AS kind,
  kinds >= 3 OR config AND other OR cohesion < 0.5 AS mixed, cohesion FROM f JOIN cohesion USING (cluster))"""
MATCHED = """rules(template, priority, base, what, least, most) AS (VALUES ('rename_function', 100, 0.95, 'FUNCTION_RENAMED', 1, 99), ('add_single_function', 95, 0.92, 'FUNCTION_ADDED', 1, 1), ('add_single_function', 95, 0.92, 'FUNCTION_REMOVED', 0, 0),
  ('remove_single_function', 95, 0.92, 'FUNCTION_REMOVED', 1, 1), ('remove_single_function', 95, 0.92, 'FUNCTION_ADDED', 0, 0), ('add_multiple_functions', 90, 0.90, 'FUNCTION_ADDED', 2, 99), ('add_multiple_functions', 90, 0.90, 'FUNCTION_REMOVED', 0, 0),
  ('refactor_functions', 85, 0.88, 'FUNCTION_ADDED', 1, 99), ('refactor_functions', 85, 0.88, 'FUNCTION_REMOVED', 1, 99), ('update_api_parameters', 80, 0.85, 'PARAMETER_ADDED', 1, 99), ('update_api_parameters_removed', 80, 0.85, 'PARAMETER_REMOVED', 1, 99),
  ('update_api_surface', 75, 0.80, 'API_SURFACE_CHANGED', 1, 99), ('add_dependency', 75, 0.90, 'DEPENDENCY_ADDED', 1, 1), ('add_dependency', 75, 0.90, 'DEPENDENCY_REMOVED', 0, 0), ('remove_dependency', 75, 0.90, 'DEPENDENCY_REMOVED', 1, 1), ('remove_dependency', 75, 0.90, 'DEPENDENCY_ADDED', 0, 0),
  ('update_dependency', 75, 0.90, 'DEPENDENCY_UPDATED', 1, 1), ('update_dependencies', 70, 0.85, 'DEPENDENCY_UPDATED', 2, 99), ('modify_function', 65, 0.75, 'FUNCTION_BODY_CHANGED', 1, 99), ('update_imports', 60, 0.70, 'IMPORT_ADDED', 1, 99), ('modify_condition', 55, 0.65, 'CONDITION_CHANGED', 1, 99),
  ('update_constant', 50, 0.60, 'CONSTANT_UPDATED', 1, 99), ('add_file', 50, 0.80, 'FILE_ADDED', 1, 99), ('remove_file', 50, 0.80, 'FILE_DELETED', 1, 99), ('update_json_config', 45, 0.55, 'JSON_VALUE_CHANGED', 1, 99), ('update_yaml_config', 45, 0.55, 'YAML_VALUE_CHANGED', 1, 99),
  ('update_tests', 40, 0.60, '@test', 1, 99), ('update_config', 35, 0.55, '@config', 1, 99), ('toggle_feature_flag', 72, 0.85, 'FEATURE_FLAG_CHANGED', 1, 99), ('update_timeout', 68, 0.80, 'TIMEOUT_CHANGED', 1, 99), ('update_limit', 68, 0.80, 'LIMIT_CHANGED', 1, 99),
  ('update_retry_config', 65, 0.78, 'RETRY_CONFIG_CHANGED', 1, 99), ('update_endpoint', 67, 0.80, 'ENDPOINT_CHANGED', 1, 99), ('update_credential', 78, 0.88, 'CREDENTIAL_CHANGED', 1, 99), ('add_schema_field', 82, 0.90, 'SCHEMA_FIELD_ADDED', 1, 99), ('remove_schema_field', 82, 0.90, 'SCHEMA_FIELD_REMOVED', 1, 99),
  ('update_schema_field', 80, 0.88, 'SCHEMA_FIELD_CHANGED', 1, 99), ('add_migration', 88, 0.92, 'MIGRATION_ADDED', 1, 99), ('update_auth_flow', 76, 0.85, '#security', 1, 99), ('update_auth_flow', 76, 0.85, 'FUNCTION_BODY_CHANGED', 1, 99), ('update_permissions', 74, 0.82, '#security', 1, 99),
  ('update_file', 20, 0.40, 'FILE_CONTENT_CHANGED', 1, 99), ('generic_update', 0, 0.30, '*', 1, 99)),
need AS (SELECT template, count(*) AS need FROM rules GROUP BY 1),
facts AS (SELECT cluster, category AS what, count(*) AS n FROM signals GROUP BY 1, 2 UNION ALL SELECT cluster, '#' || tag, count(*) FROM signals GROUP BY 1, 2 UNION ALL SELECT cluster, '@' || kind, 1 FROM kinds UNION ALL SELECT cluster, '*', 1 FROM kinds),
met AS (SELECT k.cluster, r.template, any_value(r.priority) AS priority, any_value(r.base)::DOUBLE AS base, count(*) AS met FROM kinds k CROSS JOIN rules r LEFT JOIN facts USING (cluster, what) WHERE coalesce(facts.n, 0) BETWEEN least AND most GROUP BY 1, 2),
matched AS (SELECT cluster, template, base, priority, count(*) OVER (PARTITION BY cluster) AS n_matches FROM met JOIN need USING (template) WHERE met = need QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY base DESC, priority DESC, template) = 1)"""


@query(f"WITH {SIGNALS}, {COHESION} SELECT cluster, n, round(cohesion, 6) AS cohesion FROM cohesion")
def cohesion(spark, sf_dir):
    return signals.cohesion(src.signals(spark, sf_dir))


@query(f"WITH {SIGNALS}, {COHESION}, {KINDS} SELECT cluster, kind, mixed FROM kinds")
def cluster_type(spark, sf_dir):
    return signals.cluster_types(src.signals(spark, sf_dir))


@query(f"WITH {SIGNALS}, {COHESION}, {KINDS}, {MATCHED} SELECT cluster, template, base, priority, n_matches FROM matched")
def template_match(spark, sf_dir):
    return signals.template_matches(src.signals(spark, sf_dir))


@query(f"""WITH {SIGNALS}, {COHESION}, {KINDS}, {MATCHED},
m AS (SELECT cluster, count(*) AS n, sum(confidence)::DOUBLE / count(*) AS mean, count(DISTINCT path) AS files, exp(sum(ln(enriched))) AS enriched, count_if(category = 'FUNCTION_RENAMED') AS a,
  count_if(category IN ('SCHEMA_FIELD_ADDED', 'SCHEMA_FIELD_REMOVED', 'SCHEMA_FIELD_CHANGED', 'MIGRATION_ADDED')) AS b, count_if(category IN ('FEATURE_FLAG_CHANGED', 'CREDENTIAL_CHANGED')) AS c,
  count_if(category IN ('DEPENDENCY_ADDED', 'DEPENDENCY_REMOVED', 'DEPENDENCY_UPDATED', 'PARAMETER_ADDED', 'PARAMETER_REMOVED')) AS d FROM signals GROUP BY 1),
x AS (SELECT cluster, template, least(1.0::DOUBLE, base * cohesion * mean * power(1.15, a) * power(1.12, b) * power(1.10, c) * power(1.08, d) * enriched) * CASE WHEN a + b + c + d > 0 THEN 1.0::DOUBLE ELSE 0.95::DOUBLE END
  * CASE WHEN n > 5 THEN greatest(0.5, 1.0 - (n - 5) * 0.04)::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN mixed THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END
  * CASE WHEN cohesion < 0.5 THEN 0.7::DOUBLE + 0.3::DOUBLE * cohesion / 0.5::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN kinds > 4 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN files > 5 THEN 0.92::DOUBLE ELSE 1.0::DOUBLE END AS v
  FROM matched JOIN kinds USING (cluster) JOIN m USING (cluster)), v AS (SELECT cluster, template, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, v)) + 1e-9::DOUBLE, 5) AS confidence FROM x)
SELECT cluster, template, confidence, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM v""")
def confidence(spark, sf_dir):
    return signals.confidence(src.signals(spark, sf_dir))


# Tool logs, activity, measurements


@query("WITH s AS (SELECT conv_id AS session, turn AS seq, list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{6,}')) AS symbols FROM conversations), n AS (SELECT *, lead(symbols, 1) OVER w AS a, lead(symbols, 2) OVER w AS b, lead(symbols, 3) OVER w AS c FROM s WINDOW w AS (PARTITION BY session ORDER BY seq))\n"
       "SELECT session, seq, coalesce(list_has_any(symbols, a), false) OR coalesce(list_has_any(symbols, b), false) OR coalesce(list_has_any(symbols, c), false) AS used FROM n")  # fmt: skip
def ser_lookahead(spark, sf_dir):
    words = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{6,}"), F.lit(0)))
    return activity.used_later(src.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), words.alias("symbols")))


@query("SELECT conv_id AS session, count(*) AS calls, count(*) FILTER (WHERE role = 'user') AS user_calls, count(DISTINCT role) AS tools, coalesce(sum(length(text)), 0)::BIGINT AS chars, max(turn) AS last_turn FROM conversations GROUP BY 1")
def tool_session_summary(spark, sf_dir):
    rows = src.table(spark, sf_dir, "conversations")
    return rows.groupBy(F.col("conv_id").alias("session")).agg(
        F.count("*").alias("calls"), F.count_if(F.col("role") == "user").alias("user_calls"), F.countDistinct("role").alias("tools"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.max("turn").alias("last_turn")
    )


@query("SELECT l_returnflag AS repo, l_linestatus AS mode, count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 3) AS median, round(quantile_cont(l_extendedprice, 0.9), 3) AS p90, round(avg(l_extendedprice), 3) AS mean, round(coalesce(stddev_samp(l_extendedprice), 0), 2) AS stddev, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY 1, 2")
def stat_block(spark, sf_dir):
    rows = src.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("repo"), F.col("l_linestatus").alias("mode"), "l_extendedprice")
    return activity.statistics(rows, ["repo", "mode"], "l_extendedprice")


@query("SELECT event_type, value AS upper_median FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS nth, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE nth = n // 2 + 1")
def upper_median(spark, sf_dir):
    return activity.upper_median(src.table(spark, sf_dir, "events"), "event_type", "value")


MONEY = "CAST(l_extendedprice AS DECIMAL(18,2))"


@query("""WITH r AS (SELECT l_returnflag || l_suppkey % 4 AS repo, l_linestatus = 'F' AS base, l_extendedprice / 1000 AS seconds, l_quantity AS plan, l_tax > 0.06 AS fallback, 20 + l_partkey % 7 AS total, l_suppkey % 20 AS selected FROM lineitem),
s AS (SELECT repo, round(coalesce(median(seconds) FILTER (WHERE base), 0) * 1000)::BIGINT AS b, round(coalesce(median(plan) FILTER (WHERE NOT base), 0) + coalesce(median(seconds) FILTER (WHERE NOT base), 0) * 1000)::BIGINT AS t,
  coalesce(avg(fallback::INT) FILTER (WHERE NOT base), 0) AS rate, sum(total) FILTER (WHERE NOT base) AS total, sum(selected) FILTER (WHERE NOT base) AS selected FROM r GROUP BY 1),
a AS (SELECT *, CASE WHEN rate = 1 AND b > 0 THEN b WHEN rate > 0 AND b > 0 AND t > 0 THEN round((1 - rate) * t + rate * b)::BIGINT ELSE t END AS adj FROM s)
SELECT repo, b AS baseline_ms, t AS total_ms, adj AS adjusted_ms, round(rate, 4) AS fallback_rate, CASE WHEN b > 0 AND adj > 0 THEN round((1 - adj / b) * 100, 1) ELSE 0 END AS time_reduction, coalesce(round((1 - selected / total) * 100, 1), 0) AS test_reduction FROM a
UNION ALL SELECT 'all', sum(b) FILTER (WHERE b > 0 AND adj > 0)::BIGINT, sum(t) FILTER (WHERE b > 0 AND adj > 0)::BIGINT, sum(adj) FILTER (WHERE b > 0 AND adj > 0)::BIGINT, NULL,
  round((1 - sum(adj) FILTER (WHERE b > 0 AND adj > 0) / sum(b) FILTER (WHERE b > 0 AND adj > 0)) * 100, 1), round((1 - sum(selected) / sum(total)) * 100, 1) FROM a""")
def reduction_report(spark, sf_dir):
    return activity.reductions(src.table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", (F.col("l_suppkey") % 4).cast("string")).alias("repo"), F.when(F.col("l_linestatus") == "F", "baseline").otherwise("selective").alias("mode"), (F.col("l_extendedprice") / 1000).alias("seconds"),
        F.col("l_quantity").alias("plan_ms"), (F.col("l_tax") > 0.06).alias("fallback"), (20 + F.col("l_partkey") % 7).alias("tests_total"), (F.col("l_suppkey") % 20).alias("tests_selected"),
    ))


@query("SELECT l_returnflag AS repo, count(*) AS runs, round(avg((l_tax > 0.06)::INT), 6) AS fallback_rate FROM lineitem GROUP BY 1")
def fallback_rates(spark, sf_dir):
    return src.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("repo")).agg(F.count("*").alias("runs"), F.round(F.avg((F.col("l_tax") > 0.06).cast("int")), 6).alias("fallback_rate"))


@query(f"WITH a AS (SELECT l_returnflag AS repo, avg(l_quantity) FILTER (WHERE l_linestatus = 'F') AS a, avg(l_quantity) FILTER (WHERE l_linestatus = 'O') AS b FROM lineitem GROUP BY 1) SELECT repo, round((b - a) / b, 6) AS nte FROM a")
def ab_compare(spark, sf_dir):
    arms = src.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("repo")).pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_quantity"))
    return arms.select("repo", F.round((F.col("O") - F.col("F")) / F.col("O"), 6).alias("nte"))


@query("SELECT l_partkey AS test, count(*) FILTER (WHERE l_returnflag = 'R') AS fails, count(*) AS retries, bool_or(l_returnflag <> 'R') AS flaky, round(1 - count(*) FILTER (WHERE l_returnflag = 'R')::DOUBLE / count(*), 6) AS confidence FROM lineitem GROUP BY 1")
def flaky(spark, sf_dir):
    failed = F.col("l_returnflag") == "R"
    return src.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("test")).agg(F.count_if(failed).alias("fails"), F.count("*").alias("retries"), F.bool_or(~failed).alias("flaky"), F.round(1 - F.count_if(failed) / F.count("*"), 6).alias("confidence"))


@query("SELECT l_partkey AS test, sum(l_quantity::BIGINT)::BIGINT AS hits, max(l_shipdate) AS last_seen FROM lineitem GROUP BY 1")
def coverage_merge(spark, sf_dir):
    return src.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("test")).agg(F.sum(F.col("l_quantity").cast("long")).alias("hits"), F.max("l_shipdate").alias("last_seen"))


@query("WITH f AS (SELECT DISTINCT l_orderkey AS run, l_partkey AS test FROM lineitem WHERE l_returnflag = 'R'), s AS (SELECT DISTINCT l_orderkey AS run, l_partkey AS test FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'R'), n AS (SELECT l_orderkey AS run, count(DISTINCT l_partkey) AS tests FROM lineitem GROUP BY 1)\n"
       "SELECT run, tests, (SELECT count(*) FROM f WHERE f.run = n.run) AS failed, (SELECT count(*) FROM (SELECT test FROM f WHERE f.run = n.run EXCEPT SELECT test FROM s WHERE s.run = n.run)) AS missed FROM n")  # fmt: skip
def shadow_metrics(spark, sf_dir):
    rows = src.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_partkey").alias("test"), (F.col("l_returnflag") == "R").alias("failed"), ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("selected"))
    once = rows.groupBy("run", "test").agg(F.bool_or("failed").alias("failed"), F.bool_or("selected").alias("selected"))
    return once.groupBy("run").agg(F.count("*").alias("tests"), F.count_if("failed").alias("failed"), F.count_if(F.col("failed") & ~F.col("selected")).alias("missed"))


def live_events(spark, sf_dir):
    return src.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("user"), F.col("event_type").alias("op"), "ts", F.get_json_object("props", "$.k").cast("int").alias("file"), "value")


@query("SELECT id, file, op, ts FROM (SELECT event_id AS id, json_extract(props, '$.k')::INT AS file, event_type AS op, ts, row_number() OVER (PARTITION BY json_extract(props, '$.k')::INT ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def activity_latest(spark, sf_dir):
    return history.latest(live_events(spark, sf_dir), ["file"], ["ts", "id"]).select("id", "file", "op", "ts")


@query("WITH g AS (SELECT DISTINCT event_type AS op, b AS bucket FROM events, range(0, 20) r(b)), c AS (SELECT event_type AS op, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-02 00:00:00')) / 900e6)::INT AS bucket, count(*) AS n FROM events GROUP BY 1, 2) SELECT op, bucket::INT AS bucket, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (op, bucket)")
def sparkline(spark, sf_dir):
    return activity.sparkline(live_events(spark, sf_dir), F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"), 20, 900)


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)\n"
       "SELECT user_id AS \"user\", min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, max({'ts': ts, 'id': event_id, 'op': event_type}).op AS op FROM s GROUP BY user_id, burst")  # fmt: skip
def debounce_sessions(spark, sf_dir):
    return activity.debounced(live_events(spark, sf_dir), "6 hours")


@query("SELECT user_id AS agent, json_extract(props, '$.k')::INT AS file, count(*) FILTER (WHERE event_type = 'click') AS added, count(*) FILTER (WHERE event_type <> 'click') AS removed FROM events GROUP BY 1, 2")
def sync_digest(spark, sf_dir):
    return live_events(spark, sf_dir).groupBy(F.col("user").alias("agent"), "file").agg(F.count_if(F.col("op") == "click").alias("added"), F.count_if(F.col("op") != "click").alias("removed"))


@query("SELECT count(*) AS events, count(DISTINCT json_extract(props, '$.k')::INT) AS files, count(DISTINCT user_id) AS agents, min(ts) AS first_ts, max(ts) AS last_ts FROM events")
def live_summary(spark, sf_dir):
    return live_events(spark, sf_dir).agg(F.count("*").alias("events"), F.countDistinct("file").alias("files"), F.countDistinct("user").alias("agents"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""WITH c AS (SELECT DISTINCT l_suppkey % 20 AS agent, l_partkey AS file FROM lineitem WHERE l_orderkey % 11 = 3), l AS (SELECT p_partkey AS a, p_partkey * 7 % 1000 AS b FROM part), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
o AS (SELECT agent, count(*) AS own, count_if(EXISTS (SELECT 1 FROM c d WHERE d.file = c.file AND d.agent <> c.agent)) AS shared FROM c GROUP BY 1),
r AS (SELECT agent, count(*) AS related FROM (SELECT DISTINCT c.agent, e.b AS file FROM c JOIN e ON e.a = c.file) n WHERE file NOT IN (SELECT file FROM c WHERE c.agent = n.agent) AND file IN (SELECT file FROM c WHERE c.agent <> n.agent) GROUP BY 1)
SELECT agent, own, shared, coalesce(related, 0) AS related FROM o LEFT JOIN r USING (agent)""")
def merge_check(spark, sf_dir):
    changes = src.table(spark, sf_dir, "lineitem").where("l_orderkey % 11 = 3").select((F.col("l_suppkey") % 20).alias("agent"), F.col("l_partkey").alias("file"))
    links = src.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") * 7 % 1000).alias("b"))
    return history.merge_check(changes, links)


# Texts and paths


@query("WITH h AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), 'href=\"([^\"]*)\"', 1)) AS target FROM pages) SELECT target, count(*) AS n, count(DISTINCT page_id) AS pages FROM h GROUP BY 1")
def reference_extraction(spark, sf_dir):
    refs = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="([^"]*)"'), F.lit(1)))
    return src.table(spark, sf_dir, "pages").select("page_id", refs.alias("target")).groupBy("target").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@query("WITH d AS (SELECT split_part(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '/', 1) AS dir FROM pages) SELECT dir, count(*) AS n FROM d GROUP BY 1 ORDER BY n DESC, dir LIMIT 12")
def topk_dirs(spark, sf_dir):
    top = F.split_part(F.regexp_replace("url", "^[a-z]+://[^/]*/?", ""), F.lit("/"), F.lit(1))
    return src.table(spark, sf_dir, "pages").groupBy(top.alias("dir")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dir").limit(12)


#: What a line of a run's log tells, by the first pattern that is in it.
RULES = [
    ("Cannot find module|Module not found|No module named|cannot find package", "module_not_found", "critical"),
    ("has no exported member|cannot import name|PackageNotFoundError|plugin was built with a different version", "import_error", "critical"),
    ("ReferenceError: .* is not defined|TypeError: .* is not a function", "import_error", "high"),
    ("error TS[0-9]+:", "type_error", "high"),
    ("fixture '[^']*' not found|ERRORS during collection|\\[build failed\\]|Test suite failed to run|(before|after)(All|Each) hook failed|Test environment .* not found|unexpected token|heap out of memory", "setup_crash", "critical"),
]
LOGS = [
    "Error: Cannot find module 'k{}'", "Module not found: Error: Can't resolve 'k{}' in '/app/src'", "ReferenceError: k{} is not defined", "TypeError: k{} is not a function", "error TS2307: Cannot find module './k{}' or its types", "error TS2304: Cannot find name 'K{}'",
    "error TS2305: Module has no exported member 'k{}'.", "ModuleNotFoundError: No module named 'k{}'", "ImportError: cannot import name 'k{}' from 'bar'", "fixture 'k{}' not found", "FAIL example/k{} [build failed]", "Test suite failed to run", "beforeAll hook failed: k{}",
    "Test environment jest-k{} not found", "Jest encountered an unexpected token", "FATAL ERROR: heap out of memory", "PASS src/k{}.test.js", "cannot find package 'k{}' in any of:", "plugin was built with a different version of k{}", "All {} tests passed",
]


# Events are lines of logs; what each kind of line tells is written down here for each of them.
@query("""WITH l AS (SELECT event_id, event_id % 20 AS k FROM events),
t(k, kind, severity) AS (VALUES (0, 'module_not_found', 'critical'), (1, 'module_not_found', 'critical'), (2, 'import_error', 'high'), (3, 'import_error', 'high'), (4, 'module_not_found', 'critical'), (5, 'type_error', 'high'), (6, 'import_error', 'critical'), (7, 'module_not_found', 'critical'),
  (8, 'import_error', 'critical'), (9, 'setup_crash', 'critical'), (10, 'setup_crash', 'critical'), (11, 'setup_crash', 'critical'), (12, 'setup_crash', 'critical'), (13, 'setup_crash', 'critical'), (14, 'setup_crash', 'critical'), (15, 'setup_crash', 'critical'), (17, 'module_not_found', 'critical'), (18, 'import_error', 'critical'))
SELECT event_id, kind, severity FROM l JOIN t USING (k)""")
def log_risk_classify(spark, sf_dir):
    line = F.replace(F.get(F.array(*map(F.lit, LOGS)), (F.col("event_id") % 20).cast("int")), F.lit("{}"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("")))
    kind, severity = activity.first_rule(line, RULES)
    return src.table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), severity.alias("severity")).where("kind IS NOT NULL")


MODULES = [("romance", "es/**"), ("romance", "fr/**"), ("germanic", "de/**"), ("germanic", "en/**"), ("web", "*/web/*")]


@query(f"WITH {VERSIONS}, r(module, pattern) AS (VALUES " + ", ".join(f"('{m}', '{paths.glob_pattern(g)}')" for m, g in MODULES) + ") SELECT DISTINCT path, module FROM base JOIN r ON regexp_matches(path, pattern)")
def module_match(spark, sf_dir):
    rules = spark.createDataFrame([(m, paths.glob_pattern(g)) for m, g in MODULES], "module string, pattern string")  # a fixed, short table
    base = src.versions(spark, sf_dir)[0].select("path")
    return base.join(F.broadcast(rules), F.expr("path rlike pattern")).select("path", "module").distinct()


@query("SELECT p_partkey AS id, lower(regexp_extract(p_type, '([^ ]+)$', 1)) AS tail, regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g') AS label, list_aggregate(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '') AS camel FROM part")
def scalar_functions(spark, sf_dir):
    camel = F.concat_ws("", F.transform(F.split("p_type", " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000)))))
    return src.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower(F.substring_index("p_type", " ", -1)).alias("tail"), F.regexp_replace("p_name", "[^A-Za-z0-9]+", "-").alias("label"), camel.alias("camel"))
