"""The corpus pipeline: toxicity, exact and near duplicates, benchmark leaks, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vinculo.functions.runtime import materialize
from vinculo.llm import block_names, decontam, minhash, sp_fst, toxicity
from vinculo.llm.queries import vocabulary


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts."""
    return block_names.drop_exact_duplicates(docs)


def near_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return minhash.drop_near_duplicates(docs, k=5, percent=80)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left: (doc_id, ids, n_tokens, round_trip)."""
    return sp_fst.encode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [("toxicity", toxic_out), ("exact dedup", exact_out), ("near dedup", near_out), ("decontamination", leaks_out), ("sentencepiece", encoded)]

#: The toxicity and near-duplicate stages have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
