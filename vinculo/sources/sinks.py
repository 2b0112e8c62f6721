"""Sinks: Parquet layers, CSV without helper columns, JSON, the property graph, score history, scenario documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_clean(df: DataFrame, path: str, entity: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{entity}")


def write_rejected(audit: DataFrame, path: str) -> None:
    audit.write.mode("overwrite").partitionBy("entity_type").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; columns that begin with an underscore are helpers and left out."""
    df.drop(*[c for c in df.columns if c.startswith("_")]).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge tables, dealt by label and edge type so that a pattern reads only its types."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("edge_type").parquet(f"{path}/edges")


def store_hops(hops: DataFrame, name: str, path: str, buckets: int = 64) -> None:
    """Tables ``<name>_by_src`` and ``<name>_by_dst`` of guarantee hops below ``path``, bucketed and sorted by either end.

    Joins of hops end to end, and the adjacency, then read matching buckets and shuffle nothing.
    """
    for end in ("src", "dst"):
        hops.repartition(buckets, end).write.mode("overwrite").option("path", f"{path}/{name}_by_{end}").bucketBy(buckets, end).sortBy(end).saveAsTable(f"{name}_by_{end}")


def write_experiment(tables: dict[str, DataFrame], path: str) -> None:
    """The result tables of an experiment, one Parquet folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def _figure(df: DataFrame) -> set[tuple]:
    hashed = F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(20,0)"))
    return {tuple(r) for r in df.groupBy("score_version").agg(F.count("*"), hashed).collect()}  # one row a version


def append_scores(scores: DataFrame, path: str) -> None:
    """Score history by version: the versions in ``scores`` are written, each replaced as a whole, and read back; others stay.

    A write that is tried again adds nothing, and a version that reads back with other rows than it was given is an error.
    ``score_version`` is text and not null.
    """
    scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("score_version").parquet(path)
    back = read_scores(scores.sparkSession, path, scores.schema)
    want = _figure(scores)
    if _figure(back.where(F.col("score_version").isin([w[0] for w in want]))) != want:
        raise RuntimeError("scores read back differ from those written")


def read_scores(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The score history of ``append_scores``; ``schema`` keeps the version as text."""
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def scenario_document(nodes: DataFrame, edges: DataFrame, loans: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row with an array of scenarios, each with its nodes, edges, loans and metrics in id order."""
    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("scenario").agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != "scenario"]))).alias(name))

    values = F.struct(*[c for c in metrics.columns if c != "scenario"]).alias("metrics")
    each = packed(nodes, "nodes").join(packed(edges, "edges"), "scenario", "left").join(packed(loans, "loans"), "scenario", "left").join(metrics.select("scenario", values), "scenario", "left")
    return each.agg(F.array_sort(F.collect_list(F.struct(F.col("scenario").alias("id"), "nodes", "edges", "loans", "metrics"))).alias("scenarios"))
