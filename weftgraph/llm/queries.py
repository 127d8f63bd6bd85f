"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, jpeg, lines, lm, mixing, pieces, quality, simhash, tokens, urls
from .common import Scratch, table


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.classes(table(spark, sf_dir, "embeddings"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.hex_fingerprint(simhash.classes(table(spark, sf_dir, "documents")))


def op4_jpeg_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = Scratch(spark).save(jpeg.store(table(spark, sf_dir, "documents").select("doc_id", "text")), compression="zstd")
    return jpeg.digests(jpeg.read(stored))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.removed_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents")).select("doc_id", "bad_posterior", "score", "kept")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digests(pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")))


def op8_lm_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), labels.where("quality = 1 and toxic = 0"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokens.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), Scratch(spark))
    return tokens.read_ids(*files)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.shares(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "passes", "finish")


def mixed_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the mix that SQL can express: sizes, and the targets of sources."""
    return mixing.shares(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


QUERIES = {
    "op1_embedding_links": op1_embedding_links,
    "op2_url_rules": op2_url_rules,
    "op3_simhash": op3_simhash,
    "op4_jpeg_payloads": op4_jpeg_payloads,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality": op6_quality,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_lm_difference": op8_lm_difference,
    "op9_token_files": op9_token_files,
    "op10_source_mix": op10_source_mix,
    "mixed_targets": mixed_targets,
}
ORACLE_SQL: dict[str, str] = {
    "op1_embedding_links": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), r(vec_id, low) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.vec_id WHERE r.low < l.b
), c AS (SELECT vec_id, min(low) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op2_url_rules": """
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages
), r(rule_host, rule_path, rule_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT DISTINCT host, path FROM p WHERE host <> ''),
f AS (
  SELECT host, path, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS k
  FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, p.host, p.path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM p LEFT JOIN f ON p.host = f.host AND p.path = f.path AND k = 1""",
    "mixed_targets": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source
), r AS (
  SELECT *, 3 * source_size / w AS ratio, sum(source_size) OVER () AS total, row_number() OVER o AS k,
         sum(3 * source_size) OVER o - 3 * source_size AS before, sum(w) OVER () - (sum(w) OVER o - w) AS rest
  FROM s WINDOW o AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), l AS (SELECT arg_min((total - before) / rest, k) AS level FROM r WHERE (total - before) / rest <= ratio)
SELECT d.doc_id, d.size, r.source_size, round(least(3.0 * r.source_size, coalesce(l.level, 1e300) * r.w)::DOUBLE, 3) AS target
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source CROSS JOIN l""",
}
