"""The registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, exact_dedup, langid, licences, mixing, ngram_join, pieces, quality, sharding, tokencounts, vectors, warc, whitening
from .common import table


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n
"""


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"), words=4, percent=85)


OP1_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
             ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i : i + 3], ' '))) END AS shingles FROM w),
n AS (SELECT doc_id, len(shingles) AS n FROM s),
u AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, min(r.root) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY 1, 2
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).drop("url", "payload")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, list_aggregate(list_transform(range(32), lambda i:
          substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)),
          'string_agg', '') AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(table(spark, sf_dir, "documents"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: sources are directories, and every twenty-fifth document is a licence file."""
    docs = table(spark, sf_dir, "documents")
    shelf = F.concat_ws("/", F.coalesce("source", F.lit("none")), (F.col("doc_id") % 4).cast("string"), F.floor(F.col("doc_id") / 2000).cast("string"))
    name = F.when(F.col("doc_id") % 100 < 4, F.lit("/LICENSE.txt")).otherwise(F.concat(F.lit("/texts/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return licences.licensed(docs.select("doc_id", F.concat(shelf, name).alias("path"), "text"), keep=("doc_id",))


def op5_sql() -> str:
    w = licences.Weights()
    terms = ", ".join(f"('{t}', {x!r}::DOUBLE, [{', '.join(repr(v.get(t, 0.0)) for v in w.vectors)}]::DOUBLE[])" for t, x in sorted(w.idf.items()))
    names = ", ".join(f"'{n}'" for n in w.names)
    file = "regexp_matches(path, '(?i)(^|/)(licen[cs]es?|copying|notice|unlicense)(\\.[a-z]+)?$')"
    return f"""
WITH f AS (SELECT doc_id, coalesce(source, 'none') || '/' || (doc_id % 4) || '/' || CAST(floor(doc_id / 2000) AS BIGINT) || CASE WHEN doc_id % 100 < 4 THEN '/LICENSE.txt' ELSE '/texts/' || doc_id || '.txt' END AS path, text FROM documents),
t(term, idf, v) AS (VALUES {terms}),
l AS (SELECT doc_id, path, unnest(list_concat(regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r'), CASE WHEN {file} THEN [coalesce(text, '')] ELSE [] END)) AS line FROM f),
c AS (SELECT path, row_number() OVER () AS p, regexp_extract_all(lower(line), '[a-z0-9]+(?:[.-][a-z0-9]+)*') AS w FROM l),
e AS (SELECT path, p, w AS term, count(*) AS n FROM (SELECT path, p, unnest(w) AS w FROM c) GROUP BY ALL),
z AS (SELECT path, p, sqrt(sum((n * coalesce(idf, {w.unseen!r})) ** 2)) AS len FROM e LEFT JOIN t USING (term) GROUP BY ALL),
d AS (SELECT path, p, i, sum(n * idf * v[i + 1]) AS dot FROM e JOIN t USING (term), range({len(w.names)}) r(i) GROUP BY ALL),
s AS (SELECT path, max({{'score': round(dot / len, 6), 'minus': -i}}) AS x FROM d JOIN z USING (path, p) WHERE round(dot / len, 6) >= {licences.THRESHOLD} GROUP BY ALL),
own AS (SELECT path, [{names}][1 - x.minus] AS licence, x.score AS score, {file} AS of_file FROM s),
g AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, arg_max({{'licence': licence, 'score': score, 'path': path}}, score) AS x FROM own WHERE of_file GROUP BY 1),
n AS (SELECT f.path, arg_max(g.x, length(g.dir)) AS x FROM (SELECT DISTINCT path FROM f) f JOIN g ON starts_with(f.path, g.dir || '/') GROUP BY 1)
SELECT f.doc_id, f.path, coalesce(own.licence, n.x.licence) AS licence, coalesce(own.score, n.x.score) AS score,
  CASE WHEN own.licence IS NOT NULL THEN CASE WHEN of_file THEN 'file' ELSE 'header' END WHEN n.path IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis,
  CASE WHEN own.licence IS NOT NULL THEN f.path ELSE n.x.path END AS from_path
FROM f LEFT JOIN own ON own.path = f.path LEFT JOIN n ON n.path = f.path
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE g AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.vec_id),
n AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
SELECT r.vec_id, coalesce(max(n.n), 0) AS n_links, min(r.root) AS component_id, r.vec_id = min(r.root) AS kept, CAST(1.0 AS DOUBLE) AS recall
FROM r LEFT JOIN n ON n.a = r.vec_id GROUP BY r.vec_id
"""


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.counted(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), limit=2048)


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.coded(table(spark, sf_dir, "embeddings"))


def op12_sql() -> str:
    """The rounds of one codebook a position, each one a table: parts p, books b0 to b4, assignments by the least distance, then index."""
    near = """SELECT * FROM (SELECT p.row, p.vec_id, p.label, p.pos, p.part, b.entry, list_inner_product(p.part, p.part) - 2 * list_inner_product(p.part, b.part) + list_inner_product(b.part, b.part) AS apart
  FROM p JOIN {book} b ON b.pos = p.pos) QUALIFY row_number() OVER (PARTITION BY row, pos ORDER BY apart, entry) = 1"""
    rounds = "".join(
        f""",
a{i} AS MATERIALIZED ({near.format(book=f"b{i}")}),
m{i} AS (SELECT pos, entry, list(mean ORDER BY j) AS part FROM (SELECT pos, entry, j, floor(sum(part[j]) / count(*)) AS mean FROM a{i}, range(1, 1 + len(part)) r(j) GROUP BY ALL) GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT b{i}.pos, b{i}.entry, coalesce(m{i}.part, b{i}.part) AS part FROM b{i} LEFT JOIN m{i} ON m{i}.pos = b{i}.pos AND m{i}.entry = b{i}.entry)"""
        for i in range(4)
    )
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT row, vec_id, label, pos, x[pos * (len(x) // 4) + 1 : (pos + 1) * (len(x) // 4)] AS part FROM v, range(4) r(pos)),
b0 AS MATERIALIZED (SELECT pos, row - 1 AS entry, part FROM p WHERE row <= 256){rounds},
a AS MATERIALIZED ({near.format(book="b4")}),
e AS (SELECT row, vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, CAST(sum(apart) AS BIGINT) AS error FROM a GROUP BY ALL),
h AS (SELECT sha256(string_agg(CAST(CAST(value AS BIGINT) AS VARCHAR), ',' ORDER BY pos, entry, j)) AS sha FROM (SELECT pos, entry, j, part[j] AS value FROM b4, range(1, 1 + len(part)) r(j)))
SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM e, h
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_warc, op3_sharding, op4_exact_dedup, op5_licences, op6_mixing, op7_vectors, op8_sentencepiece, op9_quality, op10_language, op11_token_counts, op12_codes, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1_SQL, "op2_warc": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op5_licences": op5_sql(), "op7_vectors": OP7_SQL, "op12_codes": op12_sql()}
