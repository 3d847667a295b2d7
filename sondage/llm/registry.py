"""Queries of this subpackage, each over its whole table, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, decontamination, hard_negatives, jaccard_join, language_id, language_model, piece_bpe, quality_classifier, quality_rules, sharding, token_counts, url_filter
from ._common import shared_path, written

TOKENIZER_DIR = "/opt/tokenizers"

URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of piece_bpe_32k.model; the cache is fresh, so that every distinct text is encoded."""
    tokenizer = token_counts.Tokenizer(f"{TOKENIZER_DIR}/piece_bpe_32k.model")
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer, shared_path(spark, "token-cache"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_model.is_fold("doc_id", 7, 2)
    model = language_model.train(docs.where(~held_out))
    return language_model.score(docs, model, held_out)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    features = written(quality_classifier.with_features(docs).drop("text"), "quality-features")
    held_out = language_model.is_fold("doc_id", 5, 0)
    model = quality_classifier.fit(features.where(~held_out), table(spark, sf_dir, "labels"))
    scored = features.select("doc_id", held_out.alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_model.is_fold("doc_id", 5, 0)
    model = language_id.fit(docs.where(~held_out))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge_documents(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", *quality_rules.BASE, "base_failed", (F.col("kept") & ~F.col("base_failed")).alias("kept"), "posterior")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), f"{TOKENIZER_DIR}/byte_bpe_50k.json")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_documents(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), vec_id % 100 == 0, moved)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


OP6_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rule_host, rule_path, verdict) AS (VALUES
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (
  SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path
                            ORDER BY length(r.rule_host) + length(r.rule_path) DESC) AS n
  FROM p JOIN r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON m.n = 1 AND m.page_id = p.page_id AND m.host = p.host AND m.path = p.path
"""

OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_sum(list_transform(range(1, 65), lambda i: a.x[i] * b.x[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 5
"""

_OP13_ROUND = """
a{r} AS (
  SELECT vec_id, cluster, distance FROM (
    SELECT v.vec_id, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS distance FROM v JOIN c{r} c ON c.i = v.i GROUP BY v.vec_id, c.cluster)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1),
"""
_OP13_MEANS = """
c{next} AS (
  SELECT c.cluster, c.i, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x) AS x
  FROM c{r} c LEFT JOIN (SELECT a.cluster, v.i, sum(v.x) AS s, count(*) AS n FROM a{r} a JOIN v USING (vec_id) GROUP BY ALL) m
    ON m.cluster = c.cluster AND m.i = c.i),
"""
OP13_SQL = (
    """
WITH v AS (
  SELECT vec_id, i, CAST(floor(64 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
  FROM embeddings, range(1, 65) t(i)
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster FROM v WHERE i = 1 QUALIFY cluster < 16),
c0 AS (SELECT cluster, i, x FROM f JOIN v USING (vec_id)),
"""
    + "".join(_OP13_ROUND.format(r=r) + _OP13_MEANS.format(r=r, next=r + 1) for r in range(3))
    + _OP13_ROUND.format(r=3)
    + """
h AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INT) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a3 JOIN h USING (cluster)
"""
)

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_sharding": op2_sharding,
    "op3_language_model": op3_language_model,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_language_id": op5_language_id,
    "op6_url_filter": op6_url_filter,
    "op7_quality_rules": op7_quality_rules,
    "op8_bpe": op8_bpe,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_decontamination": op10_decontamination,
    "op11_piece_bpe": op11_piece_bpe,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_centroids": op13_centroids,
}
ORACLE_SQL: dict[str, str] = {"op6_url_filter": OP6_SQL, "op12_hard_negatives": OP12_SQL, "op13_centroids": OP13_SQL}
