"""Exact duplicates by deterministic block naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinculo.functions.runtime import ROW, materialize, with_rows

BLOCK_BYTES = 1024


def normalised(text: Column | str) -> Column:
    """White space runs as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _named(keys: DataFrame, by: list[str]) -> DataFrame:
    """Integer names, in sorted order, for the rows of ``keys``, which are distinct.

    The range sort numbers the keys; they are written once, so that every reader sees the same
    names even when a task is run again.
    """
    return materialize(keys.orderBy(*by).withColumn("name", F.monotonically_increasing_id() + 1))


def block_identity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, text_sha256, copies, level, name), one row per id and text: two rows have equal (level, name) iff their texts are equal.

    The normalised text is cut into blocks of ``block_bytes`` bytes. Distinct blocks are sorted and
    get integer names; then adjacent names are paired and the distinct pairs sorted and named,
    until one name is left. A document that is done leaves with the number of its level, so
    documents of different lengths cannot meet. Names come from sorting whole blocks, so there are
    no collisions. Rows carry a SHA-256 of their block to find its name without moving the block
    again; that each digest stands for one block is checked over all distinct blocks, and otherwise
    an error is raised.
    Empty and null texts are one class; ``copies`` counts the rows that repeat an id and a text.
    """
    text = F.encode(normalised(text_col), "utf-8")
    parts = F.greatest(F.ceil(F.length("t") / F.lit(block_bytes)), F.lit(1)).cast("int")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")).select("id", F.sha2("t", 256).alias("text_sha256"), parts.alias("parts"), "t")
    each = rows.select("id", "text_sha256", "parts", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.substring(F.col("t"), i * block_bytes + 1, F.lit(block_bytes)))).alias("pos", "block"))
    each = each.withColumn("digest", F.unhex(F.sha2("block", 256)))
    distinct = each.select("digest", "block").distinct()  # blocks move once; their order is by first bytes, then digest
    blocks = _named(distinct.select(F.substring("block", 1, 16).alias("head"), "digest"), ["head", "digest"])
    clash = blocks.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if clash:
        raise RuntimeError("two blocks share a SHA-256 digest")
    slim = each.groupBy("id", "text_sha256", "parts", "pos", "digest").agg(F.count("*").alias("copies"))
    now = materialize(slim.join(blocks.select("digest", "name"), "digest").select("id", "text_sha256", "parts", "copies", "pos", "name"))
    level, done = 0, []
    most = now.agg(F.max("parts")).first()[0] or 1
    while True:
        done.append(now.where("parts = 1").select("id", "text_sha256", "copies", F.lit(level).alias("level"), "name"))
        if most <= 1:
            break
        rest = now.where("parts > 1")
        pairs = rest.groupBy("id", "text_sha256", "parts", "copies", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("pos") % 2 == 1, F.col("name")).otherwise(F.lit(0))).alias("b"))
        names = _named(pairs.select("a", "b").distinct(), ["a", "b"])
        now = materialize(pairs.join(names, ["a", "b"]).select("id", "text_sha256", F.ceil(F.col("parts") / 2).cast("int").alias("parts"), "copies", "pos", "name"), names)
        level, most = level + 1, (most + 1) // 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: (id, keep_id, group_size, kept, text_sha256).

    ``keep_id`` is the smallest id among the equal texts. Null text counts as empty; very long texts are
    read whole. Rows without an id and rows that repeat an id are documents of their own, ordered by id
    (null last) and text; of equal texts one row is kept, the first. An empty table gives an empty
    result. Other columns of ``docs`` are not read.
    """
    docs, unique = with_rows(docs, id_col, text_col)
    rows = block_identity(docs, ROW, text_col, block_bytes)
    groups = rows.groupBy("level", "name").agg(F.min("id").alias("keep"), F.sum("copies").alias("group_size"))
    out = rows.join(groups, ["level", "name"]).select("id", "keep", "group_size", (F.col("id") == F.col("keep")).alias("kept"), "text_sha256")
    if not unique:
        names = docs.select(F.col(ROW).alias("row"), F.col(id_col).alias("name"))
        out = out.join(names.select(F.col("row").alias("keep"), F.col("name").alias("least")), "keep").join(names.withColumnRenamed("row", "id"), "id")
        out = out.drop("id", "keep").withColumnRenamed("name", "id").withColumnRenamed("least", "keep")
    return out.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), "group_size", "kept", "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of equal texts, that with the smallest id; all columns stay.

    Rows without an id come last, and each of them and of the rows that repeat an id is judged by its own text.
    """
    rows, _ = with_rows(docs, id_col, text_col)
    keep = exact_duplicates(rows.select(ROW, text_col), ROW, text_col).where("kept").select(ROW)
    return rows.join(keep, ROW, "left_semi").select(*docs.columns)
