"""One query per training-data operator over its whole table, and the SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspark.llm import decontam, html_main, packing, pii, quality, simhash, token_counts, topk, toxicity, warc
from glosspark.llm.common import table


def _predicted(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _predicted(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), 0.5)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.captures_of(table(spark, sf_dir, "pages")))
    header = lambda name: F.col("headers")[name].alias(name.replace("-", "_"))
    return found.select("record_id", "url", "ts", "base_id", "status", header("content-type"), header("content-length"), header("date"), header("expires"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 4096)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _predicted(quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), 0.3)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_pii, op3_warc_revisits, op4_packing, op5_html_main, op6_token_counts, op7_quality, op8_decontamination, op9_top_k, op10_simhash)}

ORACLE_SQL = {
    "op3_warc_revisits": r"""
WITH p AS (
  SELECT page_id, md5(html) AS tag, octet_length(encode(html)) AS size,
         regexp_replace(regexp_replace(trim(url), '(?s)#.*$', ''), '^https?://(www[.])?', '', 'i') AS bare
  FROM pages),
c AS (
  SELECT page_id, tag, size,
         regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', '') ||
         regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') || regexp_extract(bare, '(?s)^[^?]*(.*)$', 1) AS url
  FROM p),
j AS (
  SELECT r.page_id, r.url, r.tag, f.page_id AS base, f.tag AS base_tag, f.size,
         row_number() OVER (PARTITION BY r.page_id ORDER BY f.page_id DESC NULLS LAST) AS k
  FROM c r LEFT JOIN c f ON f.url = r.url AND f.page_id * 10 < r.page_id * 10 + 50000)
SELECT page_id * 2 + 1 AS record_id, url, page_id * 10 + 50000 AS ts, base * 2 AS base_id,
       CASE WHEN base IS NULL THEN 'orphan' WHEN tag = base_tag THEN 'resolved' ELSE 'mismatch' END AS status,
       CASE WHEN tag = base_tag THEN 'text/html' ELSE 'text/plain' END AS content_type,
       CASE WHEN tag = base_tag THEN CAST(size AS VARCHAR) END AS content_length,
       CAST(page_id * 10 + 50000 AS VARCHAR) AS date, CAST(page_id * 10 + 60000 AS VARCHAR) AS expires
FROM j WHERE k = 1""",
    "op8_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
hit AS (
  SELECT x.doc_id, x.i, x.size, win.item_id
  FROM (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size) x
  JOIN win ON win.size = x.size AND win.s = array_to_string(x.w[x.i:x.i + x.size - 1], ' ')),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op9_top_k": """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, n ORDER BY score DESC, vec_id) AS k FROM s) WHERE k <= 5""",
}
