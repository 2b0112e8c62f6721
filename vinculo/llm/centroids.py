"""Clustering by centroids with integer arithmetic in JVM expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinculo.functions.runtime import forget, materialize
from vinculo.llm.vectors import whole_vectors


def nearest(vector: Column, centroids: list[list[int]]) -> Column:
    """struct(distance, cluster) of the centroid of least squared distance, the smaller number at ties."""

    def distance(centre: list[int]) -> Column:
        literal = F.expr(f"array({', '.join(f'{c}L' for c in centre)})")
        squares = F.zip_with(vector, literal, lambda a, b: (a - b) * (a - b))
        return F.aggregate(squares, F.lit(0).cast("bigint"), lambda s, x: s + x)

    return F.array_min(F.array(*[F.struct(distance(c).alias("distance"), F.lit(n).alias("cluster")) for n, c in enumerate(centroids)]))


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """((id, cluster, distance) of each vector, the final centroids).

    Vectors with exactly ``dims`` components, none null or non-finite, become floor(scale * x). The centroids start as the
    ``k`` vectors of smallest sha256 of ``<seed>:<id>`` (rows without an id last; ties by the vector; fewer vectors give
    fewer centroids). Each round every vector goes to its nearest centroid, whose literal arrays are part of the plan;
    the columns' sums are combined before the shuffle of at most k rows a task, and floor(sum / count) is the new
    centroid; an empty one stays. All is DataFrame expressions. The driver holds k centroids; vectors are never shuffled,
    so one that a third of the rows share costs no more than others.

    Rows that repeat an id are vectors of their own; other columns are not read; an empty table, or one without such
    vectors, gives an empty result and no centroids. A scaled component of 2^26 or more is an error.
    """
    rows = materialize(whole_vectors(vectors.where(F.size(F.col(vector_col)) == dims), scale, vector_col, id=id_col))
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    centroids = [list(r.v) for r in rows.orderBy(first.asc_nulls_last(), "v").limit(k).collect()]
    for _ in range(rounds if centroids else 0):
        near = rows.select(nearest(F.col("v"), centroids)["cluster"].alias("cluster"), *[F.col("v")[i].alias(f"x{i}") for i in range(dims)])
        for r in near.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"x{i}") for i in range(dims)]).collect():  # at most k rows
            centroids[r.cluster] = [r[f"x{i}"] // r.n for i in range(dims)]
    if not centroids:
        return rows.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), []
    found = rows.select("id", nearest(F.col("v"), centroids).alias("near")).select(F.col("id").alias(id_col), F.col("near.cluster").alias("cluster"), F.col("near.distance").alias("distance"))
    found = materialize(found)
    forget(rows)
    return found, centroids


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``found`` of ``cluster`` with cluster_inertia, inertia and centroid_sha256; joined with one row per centroid."""
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most k rows
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    per = [(n, sums[n], sum(sums.values()), digest(centroids[n])) for n in sums]
    figures = found.sparkSession.createDataFrame(per, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(figures), "cluster").select(*found.columns, "cluster_inertia", "inertia", "centroid_sha256")
