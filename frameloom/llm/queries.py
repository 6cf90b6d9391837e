"""The registered query of each operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bitsliced, cotrain, decontaminate, langid, minhash, packing, prefixcounts, secretscan, sharding, substring


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Similarity(k=3, num=85, den=100))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op6_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixcounts.prefix_token_counts(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.exact_top_k(table(spark, sf_dir, "embeddings"))


def op9_quality_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_extendible_sharding, op2_substring_dedup, op3_minhash_near_dedup, op4_secret_scan, op5_best_fit_packing,
        op6_prefix_token_counts, op7_benchmark_decontamination, op8_bit_sliced_top_k, op9_quality_co_training, op10_language_id,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_extendible_sharding": f"""
WITH rows AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) + 64 AS BIGINT) AS n_bytes,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS h
  FROM documents),
up AS (SELECT doc_id, n_bytes, h, d, h >> (60 - d) AS p FROM rows, (SELECT unnest(range(0, 25)) AS d)),
nodes AS (SELECT d, p, sum(n_bytes) AS b FROM up GROUP BY d, p),
leaf AS (
  SELECT doc_id, h, n_bytes, arg_min(p, d) AS p, min(d) AS depth, arg_min(b, d) AS b
  FROM up JOIN nodes USING (d, p) WHERE b <= {sharding.LIMIT} GROUP BY doc_id, h, n_bytes)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(p), CAST(depth AS INTEGER), '0') END AS shard,
       CAST(depth AS INTEGER) AS depth, CAST(b AS BIGINT) AS shard_bytes, FALSE AS oversized
FROM leaf
""",
        "op8_bit_sliced_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
""",
    }
