"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import os
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculo.llm import block_names, centroids, compact_windows, decontam, html_main, minhash, packing, pii, sharding, sp_fst, token_counts, toxicity, vector_codes

SHARDS = 24
#: Key of the surrogates. Without one of its own every process has a new one, so surrogates cannot be traced back.
SURROGATE_KEY = os.environ.get("VINCULO_SURROGATE_KEY", "").encode() or secrets.token_bytes(32)


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.lpt_shards(_table(spark, sf_dir, "documents"), SHARDS)


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(_table(spark, sf_dir, "pages"))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.repeated_passages(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_fst.encode(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op7_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_names.exact_duplicates(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    scored = toxicity.toxicity_scores(docs, model)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(_table(spark, sf_dir, "embeddings"))
    out = vector_codes.with_label_error(coded).withColumn("codebooks_sha256", F.lit(vector_codes.codebooks_sha256(books)))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster(_table(spark, sf_dir, "embeddings")))


QUERIES = {f.__name__: f for f in (
    op1_lpt_sharding, op2_surrogates, op3_main_text, op4_repeated_passages, op5_token_counts, op6_sentencepiece,
    op7_minmax_near_duplicates, op8_benchmark_leaks, op9_exact_duplicates, op10_toxicity,
    op11_packing, op12_vector_codes, op13_centroids)}

ORACLES = {
    "op9_exact_duplicates": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM t JOIN g USING (norm)""",
}
