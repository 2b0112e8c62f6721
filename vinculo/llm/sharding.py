"""Shards of nearly equal size by longest-processing-time scheduling of whole groups."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vinculo.functions.runtime import materialize

#: Groups of one size beyond which that size is split by a hash of the group's key.
HOT_CLASS = 1_000_000
#: Rows that one task numbers.
SLOT_ROWS = 50_000


def lpt(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Longest-processing-time schedule of ``(size, salt, groups)`` classes.

    Returns (size, salt, shard, first, last): the groups with ranks first..last of the class go to
    the shard. Equal sizes are interchangeable, so whole rounds are dealt at once: as soon as the
    loads lie within one size of each other, the next ``shards`` groups go one to each shard.
    Ties go to the lowest shard.
    """
    heap, out = [(0, s) for s in range(shards)], []
    for size, salt, groups in sorted(classes, key=lambda c: (-c[0], c[1])):
        given, left = [0] * shards, groups
        while left:
            if left >= shards and max(heap)[0] - heap[0][0] <= size:
                rounds = left // shards
                heap = [(load + rounds * size, s) for load, s in heap]
                heapq.heapify(heap)
                given = [n + rounds for n in given]
                left -= rounds * shards
                continue
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            given[s] += 1
            left -= 1
        at = 0
        for s, n in enumerate(given):
            if n:
                out.append((size, salt, s, at + 1, at + n))
                at += n
    return out


def lpt_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """Every row with its shard: (id, size, text_crc32, law, shard, slot, grown_shard).

    Rows with equal texts stay together. A group's size is the sum over its rows of UTF-8 bytes
    plus ``overhead``; the groups go, largest first, to the least-loaded shard. Null text counts as
    empty. ``slot`` numbers a shard's rows from 0 without gaps, in no order that matters.
    ``law`` is ``bytes``: sizes are as equal as whole groups allow, a group larger than a fair
    share fills its shard alone. ``grown_shard`` is null under this law. An empty table gives an
    empty result; rows that repeat an id are rows of their own.

    The driver sees one number per distinct group size, at most the square root of twice the total
    size; group ranks, the assignment and the slots are Spark jobs. A size with very many groups is
    ranked in parts, and slots are numbered in parts of about ``SLOT_ROWS`` rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + overhead).cast("bigint").alias("size"), F.crc32(text).alias("crc"), F.unhex(F.sha2(text, 256)).alias("key")))
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    counts = groups.groupBy("bytes").agg(F.count("*").alias("n")).collect()
    hot = {r.bytes: -(-r.n // HOT_CLASS) for r in counts if r.n > HOT_CLASS}
    salt = F.lit(0)
    for size, parts in hot.items():
        salt = F.when(F.col("bytes") == size, F.pmod(F.xxhash64("key"), F.lit(parts))).otherwise(salt)
    groups = groups.withColumn("salt", salt.cast("int"))
    classes = [(r.bytes, 0, r.n) for r in counts if r.bytes not in hot]
    if hot:
        classes += [tuple(r) for r in groups.where(F.col("bytes").isin(list(hot))).groupBy("bytes", "salt").agg(F.count("*")).collect()]
    plan = spark.createDataFrame(lpt(classes, shards), "bytes long, salt int, shard int, first long, last long")
    ranked = groups.withColumn("rank", F.row_number().over(Window.partitionBy("bytes", "salt").orderBy("key")))
    placed = ranked.join(plan, (ranked.bytes == plan.bytes) & (ranked.salt == plan.salt) & F.col("rank").between(F.col("first"), F.col("last"))).select("key", "shard")
    parts = max(8, -(-sum(r.n for r in groups.agg(F.sum("n").cast("bigint").alias("n")).collect() if r.n) // SLOT_ROWS))
    dealt = materialize(rows.join(placed, "key").select("id", "size", "crc", "shard", F.pmod(F.xxhash64("id", "key"), F.lit(parts)).cast("int").alias("part")))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "crc"))
    return dealt.join(offsets, ["shard", "part"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("before") + own - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
