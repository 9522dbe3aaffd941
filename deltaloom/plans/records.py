"""Queries over stored nodes, edges, logs and change signals, with the DuckDB SQL of each."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaloom.operators import activity, graph, records, signals
from deltaloom.plans.catalogue import EDGES, SIGNALS, VERSIONS
from deltaloom.plans.registry import query
from deltaloom.sources import tables as src

# Lines of an order as edges with the file they are found at, in SQL.
AT_EDGES = """at_edges AS (SELECT 'ord/' || l_orderkey AS src, l_returnflag AS type, 'part/' || l_partkey AS dst, 'supp/' || l_suppkey AS at_file FROM lineitem)"""


def at_edges(spark, sf_dir):
    name = src.named
    return src.table(spark, sf_dir, "lineitem").select(
        name("ord/", "l_orderkey").alias("src"), F.col("l_returnflag").alias("type"), name("part/", "l_partkey").alias("dst"), name("supp/", "l_suppkey").alias("at_file")
    )


# Lookups and scans


@query("SELECT event_id, event_type, ts FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC")
def nodes_by_kind(spark, sf_dir):
    rows = src.table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return rows.select("event_id", "event_type", "ts").orderBy(F.desc("ts"), F.desc("event_id"))


@query("SELECT o_orderkey * 3 AS id, EXISTS (SELECT 1 FROM orders n WHERE n.o_orderkey = o.o_orderkey * 3) AS found FROM orders o WHERE o_orderkey % 7 = 0")
def node_lookup(spark, sf_dir):
    orders = src.table(spark, sf_dir, "orders")
    return records.looked_up(orders.where("o_orderkey % 7 = 0").selectExpr("o_orderkey * 3 AS id"), orders.selectExpr("o_orderkey AS id"))


@query("SELECT event_id, props AS payload FROM events WHERE event_type = 'click'")
def raw_payload(spark, sf_dir):
    return src.table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", F.col("props").alias("payload"))


SCANS = {
    "src, type": "src = 'ord/33' AND type = 'N'", "src": "src = 'ord/33'", "at_file": "at_file = 'supp/7'", "type": "type = 'R'", "at_file, type": "at_file = 'supp/7' AND type = 'A'",
    "at_file, type, dst": "at_file = 'supp/7' AND type = 'N' AND dst = 'part/11'", "type, dst": "type = 'N' AND dst = 'part/11'", "dst, type": "dst = 'part/12' AND type = 'R'",
}


@query(f"""WITH {AT_EDGES}
SELECT 'src, type' AS scan, src, type, dst, at_file FROM at_edges WHERE src = 'ord/33' AND type = 'N'
UNION ALL SELECT 'src', src, type, dst, at_file FROM at_edges WHERE src = 'ord/33'
UNION ALL SELECT 'at_file', src, type, dst, at_file FROM at_edges WHERE at_file = 'supp/7'
UNION ALL SELECT 'type', src, type, dst, at_file FROM at_edges WHERE type = 'R'
UNION ALL SELECT 'at_file, type', src, type, dst, at_file FROM at_edges WHERE at_file = 'supp/7' AND type = 'A'
UNION ALL SELECT 'at_file, type, dst', src, type, dst, at_file FROM at_edges WHERE at_file = 'supp/7' AND type = 'N' AND dst = 'part/11'
UNION ALL SELECT 'type, dst', src, type, dst, at_file FROM at_edges WHERE type = 'N' AND dst = 'part/11'
UNION ALL SELECT 'dst, type', src, type, dst, at_file FROM at_edges WHERE dst = 'part/12' AND type = 'R'""")
def edge_scans(spark, sf_dir):
    scans = F.array_compact(F.array(*(F.when(F.expr(rule), F.lit(name)) for name, rule in SCANS.items())))
    return at_edges(spark, sf_dir).select(F.explode(scans).alias("scan"), "src", "type", "dst", "at_file")  # one pass for all scans


@query(f"WITH {AT_EDGES} SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM at_edges WHERE type = 'R' AND dst = 'part/' || p_partkey)")
def edge_exists(spark, sf_dir):
    parts = src.table(spark, sf_dir, "part").select("p_partkey", src.named("part/", "p_partkey").alias("dst"))
    return parts.join(at_edges(spark, sf_dir).where("type = 'R'"), "dst", "left_semi").select("p_partkey")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '69'")
def payload_path(spark, sf_dir):
    return src.table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k") == "69").select("event_id")


@query("""WITH s AS (SELECT p_partkey AS id, p_brand AS kind, CASE WHEN p_partkey % 2 = 0 THEN p_type || '.' || upper(p_name[1]) || p_name[2:] ELSE p_type || '.' || p_name END AS name FROM part)
SELECT id, name, regexp_matches(string_split(name, '.')[-1], '^\\p{Lu}') AS exported FROM s WHERE lower(kind) = lower('BRAND#17')""")
def file_symbols(spark, sf_dir):
    tail = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"))).otherwise(F.col("p_name"))
    rows = src.table(spark, sf_dir, "part").where(F.lower("p_brand") == "brand#17").select(F.col("p_partkey").alias("id"), F.concat_ws(".", "p_type", tail).alias("name"))
    return rows.select("id", "name", F.substring_index("name", ".", -1).rlike("^\\p{Lu}").alias("exported"))


# Updates and deletions


@query("""SELECT l_partkey, l_suppkey, l_quantity AS quantity, l_orderkey * 10 + l_linenumber AS seq FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey * 10 + l_linenumber DESC, l_quantity DESC) = 1""")
def range_replace(spark, sf_dir):
    rows = src.table(spark, sf_dir, "lineitem").selectExpr("l_partkey", "l_suppkey", "l_quantity AS quantity", "l_orderkey * 10 + l_linenumber AS seq")
    rows = rows.withColumn("last", F.struct("seq", "quantity"))
    return records.replaced(rows, ["l_partkey", "l_suppkey"], "last").drop("last")


@query("""WITH u AS (SELECT o_custkey AS id, max(o_totalprice) AS payload FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey AS id, coalesce(u.payload, c_acctbal) AS payload, u.id IS NOT NULL AS updated FROM customer LEFT JOIN u ON u.id = c_custkey""")
def payload_update(spark, sf_dir):
    new = src.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("payload"))
    nodes = src.table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_acctbal AS payload")
    return records.updated(nodes, new.join(nodes.select("id"), "id", "left_semi"), "id", "payload")


@query(f"""WITH {AT_EDGES} SELECT src, type, dst, at_file FROM at_edges WHERE src NOT IN (SELECT 'ord/' || o_orderkey FROM orders WHERE o_orderstatus = 'P')
AND dst NOT IN (SELECT 'part/' || p_partkey FROM part WHERE p_size < 10) AND NOT (type = 'R' AND at_file IN (SELECT 'supp/' || s_suppkey FROM supplier WHERE s_nationkey < 5))""")
def edge_deletes(spark, sf_dir):
    t = lambda name: src.table(spark, sf_dir, name)
    gone = (
        t("orders").where("o_orderstatus = 'P'").select(src.named("ord/", "o_orderkey").alias("src")),
        t("part").where("p_size < 10").select(src.named("part/", "p_partkey").alias("dst")),
        t("supplier").where("s_nationkey < 5").select(F.lit("R").alias("type"), src.named("supp/", "s_suppkey").alias("at_file")),
    )
    return records.deleted(at_edges(spark, sf_dir), *gone)


# The first two turns of a session are its stored totals; the others come later. Every third session was never stored.
@query("""WITH w AS (SELECT conv_id AS session, turn, role = 'user' AS mine, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+'))::BIGINT AS n FROM conversations)
SELECT session, coalesce(sum(n) FILTER (WHERE mine), 0)::BIGINT AS tokens_in, coalesce(sum(n) FILTER (WHERE NOT mine), 0)::BIGINT AS tokens_out FROM w WHERE turn >= 2 OR session % 3 <> 0 GROUP BY 1""")
def session_tokens(spark, sf_dir):
    n = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^ \\t\\n\\r]+"), F.lit(0))).cast("long")
    mine = F.col("role") == "user"
    rows = src.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", F.when(mine, n).otherwise(0).alias("tokens_in"), F.when(mine, 0).otherwise(n).alias("tokens_out"))
    sums = rows.where("turn < 2 AND session % 3 <> 0").groupBy("session").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    return records.accumulated(sums, rows.where("turn >= 2").drop("turn"), "session")


@query(r"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[(){}\[\];,.:+\-*/<>=!&|^~?@]|[^(){}\[\];,.:+\-*/<>=!&|^~?@ \t\n\r]+') AS w FROM conversations),
c AS (SELECT conv_id, turn, unnest(w) AS token, count(*) OVER () AS z FROM t), n AS (SELECT conv_id, turn, token, count(*) AS k FROM c GROUP BY ALL),
s AS (SELECT a.conv_id, a.turn, sum(least(a.k, b.k)) AS shared FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.token = b.token GROUP BY ALL)
SELECT a.conv_id, a.turn, round(CASE WHEN len(a.w) + len(b.w) = 0 THEN 1 ELSE coalesce(shared, 0) / (len(a.w) + len(b.w) - coalesce(shared, 0)) END, 6)::DOUBLE AS similarity
FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 LEFT JOIN s ON s.conv_id = a.conv_id AND s.turn = a.turn""")
def token_multiset(spark, sf_dir):
    rows = src.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    both = rows.join(rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("then")), ["conv_id", "turn"])
    return records.token_similarities(both, ["conv_id", "turn"], "text", "then").withColumn("similarity", F.round("similarity", 6))


# Joins of edges with nodes


@query(f"WITH {AT_EDGES} SELECT e.src, e.type, p_name AS path FROM at_edges e JOIN part ON e.dst = 'part/' || p_partkey WHERE p_type = 'ECONOMY'")
def edges_to_path(spark, sf_dir):
    files = src.table(spark, sf_dir, "part").where("p_type = 'ECONOMY'").select(src.named("part/", "p_partkey").alias("dst"), F.col("p_name").alias("path"))
    return at_edges(spark, sf_dir).join(files, "dst").select("src", "type", "path")


@query("SELECT 'snap-' || o_custkey AS slug, o_orderkey AS target, o_orderstatus AS kind FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def slug_node(spark, sf_dir):
    orders = src.table(spark, sf_dir, "orders")
    slugs = orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("target"))
    nodes = orders.select(F.col("o_orderkey").alias("target"), F.col("o_orderstatus").alias("kind"))
    return slugs.join(nodes, "target").select(src.named("snap-", "o_custkey").alias("slug"), "target", "kind")


@query(f"WITH {AT_EDGES} SELECT DISTINCT e.dst AS symbol, e.at_file AS caller, s_name AS name FROM at_edges e JOIN supplier ON e.at_file = 'supp/' || s_suppkey WHERE e.type = 'R'")
def callers_at(spark, sf_dir):
    nodes = src.table(spark, sf_dir, "supplier").select(src.named("supp/", "s_suppkey").alias("at_file"), F.col("s_name").alias("name"))
    return at_edges(spark, sf_dir).where("type = 'R'").select("dst", "at_file").distinct().join(nodes, "at_file").select(F.col("dst").alias("symbol"), F.col("at_file").alias("caller"), "name")


@query(f"WITH {AT_EDGES} SELECT at_file AS file, count(DISTINCT dst) AS callees, count(*) AS calls FROM at_edges WHERE type = 'A' GROUP BY 1")
def callees_of_file(spark, sf_dir):
    calls = at_edges(spark, sf_dir).where("type = 'A'").groupBy("at_file", "dst").agg(F.count("*").alias("n"))
    return calls.groupBy(F.col("at_file").alias("file")).agg(F.count("*").alias("callees"), F.sum("n").alias("calls"))


@query(f"WITH {AT_EDGES} SELECT e.src, p_name AS symbol, p_brand AS file, count(*) AS n FROM at_edges e JOIN part ON e.dst = 'part/' || p_partkey WHERE e.type = 'A' GROUP BY ALL")
def symbol_locations(spark, sf_dir):
    symbols = src.table(spark, sf_dir, "part").select(src.named("part/", "p_partkey").alias("dst"), F.col("p_name").alias("symbol"), F.col("p_brand").alias("file"))
    return at_edges(spark, sf_dir).where("type = 'A'").join(symbols, "dst").groupBy("src", "symbol", "file").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES} SELECT DISTINCT dst AS path, src AS neighbour FROM edges WHERE type IN ('TESTS', 'IMPORTS')")
def test_or_import_neighbours(spark, sf_dir):
    rows = src.edges(spark, sf_dir).where("type IN ('TESTS', 'IMPORTS')")
    return rows.select(F.col("dst").alias("path"), F.col("src").alias("neighbour")).distinct()


@query(f"WITH {EDGES} SELECT DISTINCT src AS path FROM edges ORDER BY path")
def sorted_paths(spark, sf_dir):
    return src.edges(spark, sf_dir).select(F.col("src").alias("path")).distinct().orderBy("path")


@query(f"""WITH {EDGES}, d AS (SELECT DISTINCT dst AS path, src AS neighbour FROM edges)
SELECT path, neighbour FROM d QUALIFY row_number() OVER (PARTITION BY path ORDER BY neighbour) <= 8""")
def neighbour_cap(spark, sf_dir):
    rows = src.edges(spark, sf_dir).select(F.col("dst").alias("path"), F.col("src").alias("neighbour")).distinct()
    return records.latest(rows, "path", [F.col("neighbour")], 8).select("path", "neighbour")


# Snapshots and sets


@query(f"""WITH {VERSIONS}, ws AS (SELECT * FROM head WHERE doc_id % 3 = 0), gone AS (SELECT path FROM base WHERE doc_id % 13 = 0)
SELECT coalesce(ws.path, base.path) AS path, coalesce(ws.digest, base.digest) AS digest FROM base FULL JOIN ws ON ws.path = base.path
WHERE coalesce(ws.path, base.path) NOT IN (SELECT path FROM gone)""")
def merged_file_set(spark, sf_dir):
    base, head = (v.select("doc_id", "path", "digest") for v in src.versions(spark, sf_dir))
    ws = head.where("doc_id % 3 = 0").select("path", F.col("digest").alias("new"))
    both = base.select("path", "digest").join(ws, "path", "full").select("path", F.coalesce("new", "digest").alias("digest"))
    return both.join(base.where("doc_id % 13 = 0").select("path"), "path", "left_anti")


@query(f"""WITH {VERSIONS}, m AS (SELECT base.path, base.doc_id FROM base JOIN head USING (path) WHERE base.digest <> head.digest)
SELECT path FROM m WHERE doc_id % 2 = 0 INTERSECT SELECT path FROM m WHERE doc_id % 3 = 0""")
def both_modified(spark, sf_dir):
    base, head = (v.select("doc_id", "path", "digest") for v in src.versions(spark, sf_dir))
    changed = base.join(head.select("path", F.col("digest").alias("new")), "path").where("digest <> new")
    return changed.where("doc_id % 2 = 0").select("path").intersect(changed.where("doc_id % 3 = 0").select("path"))


@query("""WITH b AS (SELECT p_brand AS file, p_type AS module, list(DISTINCT p_name) AS names FROM part WHERE p_partkey % 10 <> 0 GROUP BY 1, 2),
h AS (SELECT p_brand AS file, p_type AS module, list(DISTINCT p_name) AS names FROM part WHERE p_partkey % 10 <> 1 GROUP BY 1, 2),
d AS (SELECT coalesce(b.file, h.file) AS file, coalesce(b.module, h.module) AS module,
  len(list_filter(coalesce(h.names, []), lambda x: NOT list_contains(coalesce(b.names, []), x))) AS added,
  len(list_filter(coalesce(b.names, []), lambda x: NOT list_contains(coalesce(h.names, []), x))) AS removed
  FROM b FULL JOIN h ON b.file = h.file AND b.module = h.module)
SELECT file, module, 'API_SURFACE_CHANGED' AS category, added, removed FROM d WHERE added + removed > 0""")
def export_difference(spark, sf_dir):
    names = lambda rest, c: src.table(spark, sf_dir, "part").where(F.col("p_partkey") % 10 != rest).groupBy(F.col("p_brand").alias("file"), F.col("p_type").alias("module")).agg(F.collect_set("p_name").alias(c))
    both = names(0, "old").join(names(1, "new"), ["file", "module"], "full")
    empty = F.array().cast("array<string>")
    less = lambda a, b: F.size(F.array_except(F.coalesce(a, empty), F.coalesce(b, empty))).cast("long")
    both = both.select("file", "module", F.lit("API_SURFACE_CHANGED").alias("category"), less("new", "old").alias("added"), less("old", "new").alias("removed"))
    return both.where("added + removed > 0")


@query("""WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{5,}') AS a FROM conversations),
n AS (SELECT conv_id, turn, a, lead(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM w)
SELECT conv_id, turn, list_has_any(a, b) AS overlaps, len(list_filter(b, lambda x: list_contains(a, x))) AS n FROM n WHERE b IS NOT NULL""")
def array_overlap(spark, sf_dir):
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{5,}"), F.lit(0))
    rows = src.table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("a"))
    rows = rows.withColumn("b", F.lead("a").over(W.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")
    return rows.select("conv_id", "turn", F.arrays_overlap("a", "b").alias("overlaps"), records.overlap(F.col("a"), F.col("b")).cast("long").alias("n"))


# Ordered logs


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def most_recent(spark, sf_dir):
    return records.latest(src.table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")


@query("""SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(strlen(text), 0)::BIGINT AS size,
  (sum(coalesce(strlen(text), 0)) OVER (PARTITION BY lang ORDER BY doc_id) - coalesce(strlen(text), 0))::BIGINT AS "offset" FROM documents""")
def pack_offsets(spark, sf_dir):
    rows = src.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    return records.packed(rows, "lang", "doc_id", "size")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) - 1 AS high FROM orders)
SELECT o_custkey, o_orderkey, high <= 1 AS settled FROM o WHERE i = CASE WHEN high <= 1 THEN high ELSE high // 2 END""")
def bisect_midpoint(spark, sf_dir):
    return records.halving(src.table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey")


@query("SELECT event_id, user_id, count_if(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM events")
def milestone_segments(spark, sf_dir):
    return records.segments(src.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase").select("event_id", "user_id", "segment")


@query("""WITH r AS (SELECT event_id AS seq, user_id AS agent FROM events WHERE event_id > 400 AND user_id <> 7 ORDER BY 1 LIMIT 201)
SELECT seq, agent, (SELECT count(*) FROM r) > 200 AS has_more FROM r ORDER BY seq LIMIT 200""")
def cursor_sync(spark, sf_dir):
    return records.since(src.table(spark, sf_dir, "events").selectExpr("event_id AS seq", "user_id AS agent"), 400, 7, 200)


STATES = ["draft", "open", "approved", "changes_requested", "merged", "abandoned"]
#: The states that may follow each state of a review; the last two end it.
MOVES = {"draft": ("open", "abandoned"), "open": ("approved", "changes_requested", "merged", "abandoned"), "approved": ("merged", "changes_requested", "abandoned"), "changes_requested": ("open", "approved", "abandoned")}


@query("""WITH s AS (SELECT user_id, ts, event_id, ['draft', 'open', 'approved', 'changes_requested', 'merged', 'abandoned'][(event_id * 7 + user_id) % 6 + 1] AS state FROM events),
m AS (SELECT lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, state AS after FROM s)
SELECT before, after, count(*) AS n FROM m WHERE before <> after AND NOT (
  before = 'draft' AND after IN ('open', 'abandoned') OR before = 'open' AND after IN ('approved', 'changes_requested', 'merged', 'abandoned')
  OR before = 'approved' AND after IN ('merged', 'changes_requested', 'abandoned') OR before = 'changes_requested' AND after IN ('open', 'approved', 'abandoned')) GROUP BY 1, 2""")
def review_states(spark, sf_dir):
    state = F.get(F.array(*map(F.lit, STATES)), ((F.col("event_id") * 7 + F.col("user_id")) % 6).cast("int"))
    rows = src.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), state.alias("state"))
    return activity.transitions(rows, [(a, b) for a, follow in MOVES.items() for b in follow])


# Runs of a selection


# A test is an hour of the day. Errors of a repository's test are failures, views that follow in the same hour are retries that pass: such a failure is flaky, any other one with a large value is missed.
REPOS = """runs AS (SELECT user_id AS repo, hour(ts) AS test, event_type, value, ts, event_id FROM events),
failed AS (SELECT a.repo, a.event_id, a.value, EXISTS (SELECT 1 FROM runs b WHERE b.repo = a.repo AND b.test = a.test AND b.event_type = 'view' AND (b.ts, b.event_id) > (a.ts, a.event_id)) AS passes FROM runs a WHERE a.event_type = 'error'),
f AS (SELECT repo, count_if(NOT passes AND value > 30) AS missed, count_if(passes) AS flaky, count(*) AS errors FROM failed GROUP BY 1),
r AS (SELECT runs.repo, count(*) AS n, avg(value) FILTER (WHERE event_type = 'view') AS baseline, avg(value) FILTER (WHERE event_type = 'click') AS selective,
  any_value(coalesce(missed, 0)) AS missed, any_value(coalesce(flaky, 0)) AS flaky, any_value(coalesce(errors, 0)) AS fallbacks FROM runs LEFT JOIN f ON f.repo = runs.repo GROUP BY 1)"""


@query(f"""WITH {REPOS} SELECT repo, round(baseline, 6) AS baseline, round(selective, 6) AS selective, round(fallbacks / n, 6) AS fallback_rate, missed, flaky,
  CASE WHEN missed > 0 THEN 'missed' WHEN flaky > 0 THEN 'flaky' WHEN fallbacks > 0 THEN 'fallback' ELSE 'safe' END AS verdict FROM r""")
def repo_stats(spark, sf_dir):
    return repo_verdicts(spark, sf_dir).drop("fallbacks")


def repo_verdicts(spark, sf_dir):
    rows = src.table(spark, sf_dir, "events").select(F.col("user_id").alias("repo"), F.hour("ts").alias("test"), "event_type", "value", "ts", "event_id")
    return activity.repo_verdicts(rows, failure=F.col("event_type") == "error", passing=F.col("event_type") == "view", selected=F.col("event_type") == "click", least=30)


@query(f"""WITH {REPOS}, v AS (SELECT round(baseline, 6) AS baseline, round(selective, 6) AS selective, missed = 0 AND flaky = 0 AND fallbacks = 0 AS safe FROM r)
SELECT count(*) AS repos, round(avg(baseline), 4) AS baseline, round(avg(selective), 4) AS selective, bool_and(safe) AS all_safe FROM v""")
def cross_repo(spark, sf_dir):
    mean = lambda c: F.round(F.avg(c), 4).alias(c)
    return repo_verdicts(spark, sf_dir).agg(F.count("*").alias("repos"), mean("baseline"), mean("selective"), F.bool_and(F.col("verdict") == "safe").alias("all_safe"))


# Change signals


# Lines of an order name their part in every third order; the others have files only.
@query("""WITH s AS (SELECT l_orderkey AS cluster, CASE WHEN l_orderkey % 3 = 0 THEN 'name' || l_partkey % 4 END AS symbol, 'lib/' || l_suppkey % 2 || '/p' || l_partkey || '.go' AS path FROM lineitem),
n AS (SELECT cluster, symbol FROM (SELECT cluster, symbol, count(*) AS n FROM s WHERE symbol IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, symbol) = 1),
f AS (SELECT cluster, count(DISTINCT path) AS files, min(path) AS one, count(DISTINCT regexp_replace(path, '/[^/]*$', '')) AS dirs FROM s GROUP BY 1)
SELECT cluster, CASE WHEN symbol IS NOT NULL THEN symbol WHEN files = 1 THEN regexp_replace(regexp_extract(one, '[^/]*$', 0), '[.][^.]*$', '') WHEN dirs = 1 THEN split_part(one, '/', 2) ELSE 'lib' END AS area FROM f LEFT JOIN n USING (cluster)""")
def primary_area(spark, sf_dir):
    name = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("name"), (F.col("l_partkey") % 4).cast("string")))
    path = F.concat(F.lit("lib/"), (F.col("l_suppkey") % 2).cast("string"), F.lit("/p"), F.col("l_partkey").cast("string"), F.lit(".go"))
    return records.primary_areas(src.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cluster"), name.alias("symbol"), path.alias("path")))


@query("""WITH p AS (SELECT doc_id % 40 AS grp, string_split(concat_ws('/', coalesce(lang, 'none'), CASE WHEN doc_id % 4 < 2 THEN 'src' ELSE coalesce(source, 'none') END), '/') AS parts FROM documents),
e AS (SELECT grp, min(parts) AS a, max(parts) AS b FROM p GROUP BY 1),
s AS (SELECT grp, a[1 : len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i]))] AS shared FROM e)
SELECT grp, coalesce(list_filter(shared, lambda x: x NOT IN ('', '.'))[-1], 'codebase') AS area FROM s""")
def common_directory(spark, sf_dir):
    folder = F.concat_ws("/", F.coalesce("lang", F.lit("none")), F.when(F.col("doc_id") % 4 < 2, "src").otherwise(F.coalesce("source", F.lit("none"))), F.lit("file"))
    return records.common_area(src.table(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("grp"), folder.alias("path")), "grp", "path")


@query(f"""WITH {SIGNALS}, c AS (SELECT cluster, category, count(*) AS n FROM signals GROUP BY 1, 2),
d AS (SELECT cluster, n, CASE category WHEN 'FUNCTION_ADDED' THEN 'function added' WHEN 'FUNCTION_REMOVED' THEN 'function removed' WHEN 'FUNCTION_RENAMED' THEN 'function renamed'
  WHEN 'FUNCTION_BODY_CHANGED' THEN 'function modified' WHEN 'DEPENDENCY_ADDED' THEN 'dependency change' WHEN 'DEPENDENCY_REMOVED' THEN 'dependency change' WHEN 'DEPENDENCY_UPDATED' THEN 'dependency change'
  WHEN 'JSON_VALUE_CHANGED' THEN 'config value changed' WHEN 'YAML_VALUE_CHANGED' THEN 'config value changed'
  WHEN 'SCHEMA_FIELD_ADDED' THEN 'schema change' WHEN 'SCHEMA_FIELD_REMOVED' THEN 'schema change' WHEN 'SCHEMA_FIELD_CHANGED' THEN 'schema change' END AS what, category FROM c)
SELECT cluster, category, n || ' ' || CASE WHEN n = 1 THEN what WHEN what = 'dependency change' OR what = 'schema change' THEN what || 's'
  ELSE regexp_replace(what, '^(function|config value) ', '\\1s ') END AS what FROM d WHERE what IS NOT NULL""")
def sub_intents(spark, sf_dir):
    one = {"FUNCTION_ADDED": "function{} added", "FUNCTION_REMOVED": "function{} removed", "FUNCTION_RENAMED": "function{} renamed", "FUNCTION_BODY_CHANGED": "function{} modified"}
    one |= dict.fromkeys(signals.DEPENDENCIES, "dependency change{}") | dict.fromkeys(("JSON_VALUE_CHANGED", "YAML_VALUE_CHANGED"), "config value{} changed")
    one |= dict.fromkeys(("SCHEMA_FIELD_ADDED", "SCHEMA_FIELD_REMOVED", "SCHEMA_FIELD_CHANGED"), "schema change{}")
    words = F.element_at(F.create_map(*(F.lit(x) for kv in one.items() for x in kv)), F.col("category"))
    rows = src.signals(spark, sf_dir).where(F.col("category").isin(*one)).groupBy("cluster", "category").agg(F.count("*").alias("n"))
    what = F.concat(F.col("n").cast("string"), F.lit(" "), F.replace(words, F.lit("{}"), F.when(F.col("n") == 1, "").otherwise("s")))
    return rows.select("cluster", "category", what.alias("what"))


@query(f"""WITH {SIGNALS}, p AS (SELECT category, CASE tag WHEN 'test' THEN replace(path, '.go', '_test.go') WHEN 'config' THEN replace(path, '.md', '.yaml') WHEN 'api' THEN 'test_' || path ELSE path END AS path FROM signals),
g AS (SELECT category, regexp_matches(path, '_test[.]go$|^test_') AS of_test, regexp_matches(path, '[.]yaml$') AS of_config, count(*) AS n FROM p GROUP BY ALL)
SELECT category, of_test, of_config, n, array_to_string(list_filter([
  CASE WHEN category IN ('API_SURFACE_CHANGED', 'PARAMETER_ADDED', 'PARAMETER_REMOVED', 'FUNCTION_RENAMED') THEN 'api' END,
  CASE WHEN category IN ('FUNCTION_REMOVED', 'PARAMETER_REMOVED', 'DEPENDENCY_REMOVED', 'SCHEMA_FIELD_REMOVED') THEN 'breaking' END, CASE WHEN category = 'CREDENTIAL_CHANGED' THEN 'security' END,
  CASE WHEN category IN ('TIMEOUT_CHANGED', 'LIMIT_CHANGED', 'RETRY_CONFIG_CHANGED') THEN 'tuning' END, CASE WHEN category = 'FEATURE_FLAG_CHANGED' THEN 'feature-flag' END,
  CASE WHEN category = 'ENDPOINT_CHANGED' THEN 'config' END, CASE WHEN category LIKE 'SCHEMA_FIELD_%' OR category = 'MIGRATION_ADDED' THEN 'schema' END,
  CASE WHEN of_test THEN 'test' END, CASE WHEN of_config THEN 'config' END], lambda x: x IS NOT NULL), ',') AS tags,
  CASE WHEN category LIKE 'SCHEMA_FIELD_%' OR category IN ('FUNCTION_RENAMED', 'MIGRATION_ADDED', 'FEATURE_FLAG_CHANGED', 'CREDENTIAL_CHANGED') THEN 3
    WHEN category LIKE 'DEPENDENCY_%' OR category LIKE 'PARAMETER_%' OR category IN ('API_SURFACE_CHANGED', 'TIMEOUT_CHANGED', 'LIMIT_CHANGED', 'ENDPOINT_CHANGED') THEN 2 ELSE 1 END AS quality FROM g""")
def tags_and_quality(spark, sf_dir):
    tag, path = F.col("tag"), F.col("path")
    named = F.when(tag == "test", F.replace(path, F.lit(".go"), F.lit("_test.go"))).when(tag == "config", F.replace(path, F.lit(".md"), F.lit(".yaml"))).when(tag == "api", F.concat(F.lit("test_"), path)).otherwise(path)
    rows = src.signals(spark, sf_dir).select("category", signals.path_tags(named).alias("own"))
    rows = rows.groupBy("category", "own").agg(F.count("*").alias("n"))
    of = lambda x: F.array_contains("own", x).alias(f"of_{x}")
    return rows.select("category", of("test"), of("config"), "n", F.array_join(F.concat(signals.tags_of(F.col("category")), "own"), ",").alias("tags"), signals.quality_of(F.col("category")).alias("quality"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN regexp_replace(a, '^[\\^~>=<]+', '') <> '' AND string_split(regexp_replace(a, '^[\\^~>=<]+', ''), '.')[1] <> string_split(b, '.')[1] THEN 'config,breaking' ELSE 'config' END AS tags
FROM (SELECT l_orderkey, l_linenumber, '^' || l_linenumber || '.' || l_suppkey || '.0' AS a, (1 + l_partkey % 5) || '.0.1' AS b FROM lineitem)""")
def dependency_tags(spark, sf_dir):
    old = F.concat(F.lit("^"), F.col("l_linenumber").cast("string"), F.lit("."), F.col("l_suppkey").cast("string"), F.lit(".0"))
    new = F.concat((1 + F.col("l_partkey") % 5).cast("string"), F.lit(".0.1"))
    moved = (records.major(old) != "") & (records.major(new) != "") & (records.major(old) != records.major(new))
    return src.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(moved, "config,breaking").otherwise("config").alias("tags"))


@query(f"""WITH RECURSIVE {EDGES}, hops AS (SELECT 'region/0' AS path, 0 AS hop UNION SELECT e.src, h.hop + 1 FROM hops h JOIN edges e ON e.dst = h.path WHERE h.hop < 3 AND e.type IN ('IMPORTS', 'CALLS')),
i AS (SELECT path, min(hop) AS hop, starts_with(path, 'tests/') AS is_test FROM hops GROUP BY path HAVING min(hop) > 0)
SELECT path, hop, is_test FROM i QUALIFY row_number() OVER (PARTITION BY is_test ORDER BY hop, path) <= 20""")
def impact_top(spark, sf_dir):
    reached = graph.impact(src.edges(spark, sf_dir), spark.createDataFrame([("region/0",)], "path string"))
    return records.latest(reached, "is_test", [F.col("hop"), F.col("path")], 20).select("path", "hop", "is_test")
