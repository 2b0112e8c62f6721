"""Near duplicates by min-max hashing with exact confirmation."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculo.functions.components import connected_components
from vinculo.functions.runtime import ROW, materialize, small, with_rows
from vinculo.llm.texts import map_batches, mix, randoms, shingled

#: Rounds in which each bucket is compared with one centre before the rest goes through the prefix filter.
STAR_ROUNDS = 2
#: Counters of the frequency sketch that orders shingles for the prefix filter (8 bytes each on the driver).
SKETCH = 1 << 20


def min_max_signature(values: np.ndarray, starts: np.ndarray, permutations: int) -> np.ndarray:
    """Minimum and maximum of every permutation, for the value sets that begin at ``starts``."""
    scale, shift = randoms(permutations, 3) | np.uint64(1), randoms(permutations, 4)
    out = np.empty((2 * permutations, len(starts)), dtype=np.uint64)
    for j in range(permutations):
        x = values * scale[j] + shift[j]
        x ^= x >> np.uint64(32)
        x *= scale[-1 - j]
        out[2 * j] = np.minimum.reduceat(x, starts)
        out[2 * j + 1] = np.maximum.reduceat(x, starts)
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` signature values, the band's number mixed in."""
    bands = len(signature) // rows
    factor = randoms(rows, 5) | np.uint64(1)
    grouped = signature[: bands * rows].reshape(bands, rows, -1)
    keys = sum((mix(grouped[:, r] ^ factor[r]) * factor[r] for r in range(rows)), start=np.zeros(grouped[:, 0].shape, dtype=np.uint64))
    return mix(keys + randoms(bands, 6)[:, None]).T


def _sign(k: int, permutations: int, rows: int):
    def run(batch: dict[str, list]) -> dict[str, list]:
        sets: list[np.ndarray] = [np.zeros(0, dtype=np.uint64)] * len(batch["id"])
        out = {"id": batch["id"], "n": [], "digest": [], "bands": []}
        keys: list = [None] * len(sets)
        pending, at = [], 0

        def flush() -> None:
            if pending:
                starts = np.cumsum([0] + [len(sets[i]) for i in pending[:-1]])
                for i, row in zip(pending, band_keys(min_max_signature(np.concatenate([sets[i] for i in pending]), starts, permutations), rows), strict=True):
                    keys[i] = row.view(np.int64).tolist()
                pending.clear()

        for i, _, s in shingled(batch["text"], k):
            sets[i] = np.unique(s)
            if len(sets[i]):
                pending.append(i)
                at += len(sets[i])
                if at > 100_000:
                    flush()
                    at = 0
        flush()
        for s, b in zip(sets, keys, strict=True):
            out["n"].append(len(s))
            out["digest"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            out["bands"].append(b)
        return out

    return run


def _sets(k: int):
    def run(batch: dict[str, list]) -> dict[str, list]:
        sets: list = [[]] * len(batch["id"])
        for i, _, s in shingled(batch["text"], k):
            sets[i] = np.unique(s).view(np.int64).tolist()
        return {"id": batch["id"], "shingles": sets}

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = one.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * inter >= percent * (F.size("sa") + F.size("sb") - inter)).select("a", "b")


def _prefixes(percent: int, counts: np.ndarray):
    """Of each set the rare shingles that decide (without those that occur once), and their ranks."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        out, ranks = [], []
        for shingles in batch["shingles"]:
            s = np.array(shingles, dtype=np.int64)
            n, often = len(s), counts[s & (SKETCH - 1)]
            first = np.lexsort((s, often))[: n - -(-percent * n // 100) + 1]
            held = np.flatnonzero(often[first] > 1)
            out.append(s[first][held])
            ranks.append(held)
        return {"id": batch["id"], "component": batch["component"], "n": batch["n"], "prefix": out, "ranks": ranks}

    return run


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int, fits) -> DataFrame:
    """All pairs (a, b) of ``nodes(id, component)`` in different components that can reach the similarity.

    Two sets of n and m shingles with o in common share, in any order of the shingles, one of the
    first n - o + 1 of the one and the first m - o + 1 of the other. Rare shingles come first here,
    so in a large family of edited copies these hold a set's own edits, and only sets with edits in
    common meet. The order comes from a sketch of bounded size; where
    several shingles share its counters it stays an order.
    """
    held = materialize(nodes.join(sets, "id").withColumn("n", F.size("shingles")))
    slot = F.explode("shingles").alias("s")
    counts = np.zeros(SKETCH, dtype=np.int64)
    sketch = held.select(slot).groupBy(F.col("s").bitwiseAND(SKETCH - 1).alias("slot")).count().toArrow()  # at most 16 MB, without a Python object per row
    counts[sketch["slot"].to_numpy()] = sketch["count"].to_numpy()
    shared = held.sparkSession.sparkContext.broadcast(counts)
    prefixes = map_batches(held, lambda batch: _prefixes(percent, shared.value)(batch), "id long, component long, n int, prefix array<long>, ranks array<int>")
    left = materialize(prefixes.select("id", "component", "n", F.explode(F.arrays_zip("prefix", "ranks")).alias("x")).select("id", "component", "n", F.col("x.prefix").alias("s"), F.col("x.ranks").alias("i")))
    right = left.select("s", F.col("id").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("component").alias("other"))
    least = f"ceil({percent} * (n + m) / {100 + percent})"  # the intersection that the similarity takes
    decides = F.expr(f"id < b AND component <> other AND n - i >= {least} AND m - j >= {least}")
    return left.join(right, "s").where(fits & decides).select(F.col("id").alias("a"), "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, permutations: int = 70, rows: int = 5) -> DataFrame:
    """One row per document: (id, n_shingles, component_id, kept).

    A document's set holds its distinct ``k``-word shingles (words are runs outside
    [\\x20\\x09-\\x0D] after lower-casing A-Z); with fewer words the whole sequence is one shingle;
    without words the set is empty and the document stands alone. Two documents are linked when
    100 * intersection >= percent * union; ``component_id`` is the smallest id that links reach.
    Each permutation yields its minimum and its maximum, and bands of ``rows`` of these values give
    candidates. With 70 permutations and bands of 5 a pair at similarity 0.85 is missed with
    probability under 1e-7, at 0.8 under 2e-5; links are confirmed on full sets.

    Equal sets are one class first, so groups of copies cost one representative. Within a bucket
    the member that shares most buckets is compared with all others; the next round takes the next
    such member, only for buckets that still hold several components. The members of buckets that
    then still do are compared through an exact prefix filter (see ``_prefix_pairs``). So a bucket
    of near copies costs its length, not its square, and no pair that links two components of a
    bucket is left out.

    Null text is empty; very long texts are read whole; rows without an id and rows that repeat an id are
    documents of their own, ordered by id (null last) and text, and then ``kept`` marks one row of each
    component; an empty table gives an empty result; other columns are not read.
    """
    rows_, unique = with_rows(docs, id_col, text_col)
    out = _near(rows_.select(F.col(ROW).alias("id"), F.col(text_col).alias("text")), k, percent, permutations, rows)
    out = out.withColumn("kept", F.col("id") == F.col("component_id"))
    if not unique:
        names = rows_.select(F.col(ROW).alias("row"), F.col(id_col).alias("name"))
        out = out.join(names.select(F.col("row").alias("component_id"), F.col("name").alias("least")), "component_id").join(names.withColumnRenamed("row", "id"), "id")
        out = out.select(F.col("name").alias("id"), "n_shingles", F.col("least").alias("component_id"), "kept")
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def _near(own: DataFrame, k: int, percent: int, permutations: int, rows: int) -> DataFrame:
    """(id, n_shingles, component_id) for ``own(id, text)`` with distinct ids."""
    signed = materialize(map_batches(own, _sign(k, permutations, rows), "id long, n int, digest binary, bands array<long>"))
    classes = materialize(signed.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep")))
    reps = classes.select(F.col("rep").alias("id")).join(signed, "id").groupBy("id").agg(F.max("n").alias("n"), F.max("bands").alias("bands"))
    buckets = reps.select("id", "n", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    buckets = materialize(buckets.join(shared, "band"))
    score = buckets.groupBy("id").agg(F.sum("members").alias("score"))
    members = materialize(buckets.join(score, "id").select("band", "id", "n", "score"))
    nodes = members.select("id").distinct()
    sets = materialize(map_batches(own.join(small(nodes), "id", "left_semi"), _sets(k), "id long, shingles array<long>").groupBy("id").agg(F.first("shingles").alias("shingles")))
    fits = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    links, labels = None, None
    for round_ in range(STAR_ROUNDS + 1):
        if labels is not None:
            members = members.join(labels, members.id == labels.node, "left").select("band", "id", "n", "score", F.coalesce("component", "id").alias("component"))
            open_ = members.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
            members = materialize(members.join(open_, "band"))
            if members.isEmpty():
                break
        else:
            members = members.withColumn("component", F.col("id"))
        if round_ < STAR_ROUNDS:
            centre = members.groupBy("band").agg(F.max(F.struct("score", (-F.col("id")).alias("c"), "n", "component")).alias("top"))
            centre = centre.select("band", (-F.col("top.c")).alias("centre"), F.col("top.n").alias("m"), F.col("top.component").alias("other"))
            met = members.join(centre, "band")
            pairs = met.where(fits & (F.col("component") != F.col("other"))).select(F.col("id").alias("a"), F.col("centre").alias("b"))
            members = met.where("id <> centre").select("band", "id", "n", "score")
        else:
            pairs = _prefix_pairs(members.select("id", "component").distinct(), sets, percent, fits)
        found = materialize(_confirmed(pairs.distinct(), sets, percent))
        links = found if links is None else links.unionByName(found)
        labels = materialize(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    rep = classes.join(labels, classes.rep == labels.node, "left").select("digest", F.coalesce("component", "rep").alias("component_id")) if labels is not None else classes.select("digest", F.col("rep").alias("component_id"))
    return signed.join(rep, "digest", "left").select("id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each near-duplicate component, that with the smallest id; all columns stay.

    Rows without an id come last, and each of them and of the rows that repeat an id is judged by its own text.
    """
    rows, _ = with_rows(docs, id_col, text_col)
    keep = near_duplicates(rows.select(ROW, text_col), ROW, text_col, k, percent).where("kept").select(ROW)
    return rows.join(keep, ROW, "left_semi").select(*docs.columns)
