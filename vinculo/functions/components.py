"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculo.functions.runtime import materialize


def _star(e: DataFrame) -> DataFrame:
    """One large-star and one small-star pass over edges (u, v) with u > v."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    near = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; component is the smallest node id.

    Alternates large-star and small-star passes until every node points at its component's
    smallest node, so the number of rounds grows with the logarithm of a chain's length. Each
    round is a shuffle over edges only, written to the shared folder; the driver sees two numbers.
    Null ends and self loops are ignored; an empty table gives an empty result.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), (F.col("u").isNotNull() & F.col("v").isNotNull()).alias("ok"))
    e = materialize(e.where("ok and u > v").select("u", "v").distinct())
    before = None
    for _ in range(max_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now[0] == 0 or now == before:
            break
        before, e = now, materialize(_star(e))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
