"""Benchmark passages in documents by SimHash of item-sized windows, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinculo.functions.runtime import ROW, forget, materialize, small, with_rows

SHINGLE = 5
PERCENT = 80
#: Hamming radius. At weighted similarity 0.8 fingerprints of 64 bits are 9.7 apart on average, with deviation 2.9.
RADIUS = 16
#: Distinct benchmark shingles up to which the test for them is a literal set in the plan; beyond, it is a join with the same result.
LITERAL_SET = 20_000
#: Items times longest item up to which the items' shingles are sent to every executor (8 bytes each).
INDEX_CELLS = 2_000_000


def _words(text: str) -> Column:
    """Lower-cased runs of letters and digits; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(words: str, k: int) -> Column:
    """(position, hash) of each k-word shingle."""
    w = F.col(words)
    each = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.struct(i.alias("pos"), F.xxhash64(*[w[i + j] for j in range(k)]).alias("h")))
    return F.when(F.size(w) >= k, each).otherwise(F.array().cast("array<struct<pos:int,h:bigint>>"))


def _held(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with a column that is computed once: what follows cannot be pushed below a generator."""
    return df.withColumn(name, F.explode(F.array(value)))


#: Counts of the 64 bits over the window, as 16 sums of four 16-bit lanes each; windows of fewer than 32,768 shingles.
LANES = "array(" + ", ".join(f"aggregate(win, 0L, (s, x) -> s + (shiftrightunsigned(x, {j}) & 281479271743489L))" for j in range(16)) + ")"
#: The same counts for windows of any length, one bit at a time.
PLAIN = "transform(sequence(0, 63), b -> aggregate(win, 0, (s, x) -> s + cast(shiftright(x, b) & 1L AS int)))"
FINGERPRINT = """aggregate(sequence(0, 63), 0L, (f, b) -> f | shiftleft(CASE WHEN 2 * (CASE WHEN size(win) < 32768
    THEN shiftrightunsigned(lanes[b % 16], 16 * (b div 16)) & 65535L ELSE lanes[b] END) > size(win) THEN 1L ELSE 0L END, b))"""
#: Multiset intersection: shared distinct shingles once, and what shingles that repeat within the item (``again``) add.
COMMON = """size(array_intersect(win, shingles)) + aggregate(again, 0, (s, x) -> s
    + greatest(least(size(filter(win, y -> y = x)), size(filter(shingles, y -> y = x))) - 1, 0))"""


def fingerprinted(df: DataFrame) -> DataFrame:
    """``df`` with ``fp``: bit b is set if it is set in more than half of the hashes of ``win``; repeated shingles count each time."""
    counted = _held(df, F.expr(f"CASE WHEN size(win) < 32768 THEN {LANES} ELSE {PLAIN} END"), "lanes")
    return counted.withColumn("fp", F.expr(FINGERPRINT)).drop("lanes")


def _blocks(fp: str) -> Column:
    """RADIUS + 1 blocks of the fingerprint's bits: within the radius at least one block is equal."""
    n = RADIUS + 1
    cuts = [64 * j // n for j in range(n + 1)]
    return F.array(*[F.struct(F.lit(j).alias("block"), F.expr(f"shiftright({fp}, {a}) & {(1 << (b - a)) - 1}L").alias("bits")) for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])


def _need(m: str, n: str) -> str:
    """Shared shingles that windows of ``m`` and ``n`` need for the similarity."""
    return f"({PERCENT} * ({m} + {n}) + {99 + PERCENT}) div {100 + PERCENT}"


def _found(rows: DataFrame, known: DataFrame, ks: list[int], fewest: int) -> DataFrame:
    """(ROW, k, hs, found): rows with at least ``fewest`` shingles of the benchmark, their hashes, and (pos, h) of those shingles."""
    text = _held(rows, _words("text"), "w")
    of_k = F.array(*[F.struct(F.lit(k).alias("k"), _shingles("w", k).alias("sh")) for k in ks])
    each = text.select(ROW, F.explode(of_k).alias("x")).select(ROW, "x.k", "x.sh")
    if known.select("h").distinct().count() <= LITERAL_SET:
        values = [r.h for r in known.select("h").distinct().collect()]
        inside = f"x.h IN ({', '.join(f'{h}L' if h >= -(2**63) + 1 else 'CAST(-9223372036854775808 AS BIGINT)' for h in values) or 'NULL'})"
        found = _held(each, F.expr(f"filter(sh, x -> {inside})"), "found")
    else:
        at = each.select(ROW, "k", F.explode("sh").alias("x")).select(ROW, "k", "x", F.col("x.h").alias("h"))
        at = at.join(small(known.select("h").distinct()), "h").groupBy(ROW, "k").agg(F.collect_list("x").alias("found"))
        found = each.join(at, [ROW, "k"])
    return found.where(F.size("found") >= fewest).select(ROW, "k", F.transform("sh", lambda x: x["h"]).alias("hs"), "found")


def _windows(found: DataFrame, lengths: DataFrame) -> DataFrame:
    """(ROW, k, n, start, win): the item-sized windows that hold enough shingles of items of ``n`` shingles.

    A window of ``n`` shingles can only be similar enough to an item of ``n`` if so many of its
    shingles occur in items of that length. Moving its start to the next such shingle loses none of
    them, so windows start at these. Windows that a document's end cuts off are shorter, and
    those that its begin cuts off end at such a shingle.
    """
    at = found.select(ROW, "k", F.explode("found").alias("x")).select(ROW, "k", "x.pos", "x.h")
    at = at.join(small(lengths), ["k", "h"]).groupBy(ROW, "k", "n").agg(F.sort_array(F.collect_list("pos")).alias("p"))
    laid = at.where(F.expr("5 * size(p) >= 4 * n")).join(found.select(ROW, "k", "hs"), [ROW, "k"])
    whole = "filter(transform(p, (q, i) -> struct(q AS start, least(n, size(hs) - q) AS m, i AS i)), c -> c.i + {0} <= size(p) AND p[int(c.i + {0} - 1)] < c.start + c.m)".format(_need("c.m", "n"))
    cut = f"transform(filter(transform(p, (e, i) -> struct(e AS e, i AS i)), c -> c.e < n - 1 AND c.i + 1 >= {_need('c.e + 1', 'n')}), c -> struct(0 AS start, c.e + 1 AS m, c.i AS i))"
    laid = laid.select(ROW, "k", "n", F.expr(f"explode(transform(concat({whole}, {cut}), c -> struct(c.start, slice(hs, c.start + 1, c.m) AS win)))").alias("x"))
    return laid.select(ROW, "k", "n", "x.start", "x.win")


def _leaks(rows: DataFrame, benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(ROW, item, similarity, start_word, hamming) for ``rows(ROW, text)``."""
    items = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).withColumn("w", _words("text")).where("size(w) > 0")
    items = items.withColumn("sh", F.coalesce(*[F.when(F.least(F.size("w"), F.lit(SHINGLE)) == k, _shingles("w", k)) for k in range(1, SHINGLE + 1)]))
    bench = items.select("item", F.least(F.size("w"), F.lit(SHINGLE)).alias("k"), F.size("sh").alias("n"), F.transform("sh", lambda x: x["h"]).alias("win"))
    bench = fingerprinted(bench).withColumn("again", F.expr("filter(array_distinct(win), x -> size(filter(win, y -> y = x)) > 1)"))
    bench = materialize(bench.select(F.monotonically_increasing_id().alias("no"), "item", "k", "n", F.col("win").alias("shingles"), F.col("fp").alias("item_fp"), "again"))
    size = bench.agg(F.collect_set("k").alias("ks"), F.min("n").alias("least"), F.sum(F.size("shingles")).alias("cells")).first()
    lengths = materialize(bench.select("k", "n", F.explode("shingles").alias("h")).distinct())
    found = materialize(_found(rows, lengths, sorted(size["ks"]) or [SHINGLE], -(-4 * (size["least"] or 1) // 5)))
    windows = materialize(fingerprinted(_windows(found, lengths)))
    forget(found, lengths)
    probes = windows.select("k", "n", "fp").distinct().select("k", "n", "fp", F.explode(_blocks("fp")).alias("x")).select("k", "n", "fp", "x.*")
    table = bench.select("no", "k", "n", "item_fp", F.explode(_blocks("item_fp")).alias("x")).select("no", "k", "n", "item_fp", "x.*")
    near = probes.join(small(table), ["k", "n", "block", "bits"]).withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
    near = materialize(near.where(F.col("hamming") <= RADIUS).select("k", "n", "fp", "no", "hamming").distinct())
    texts = bench.select("no", "item", "shingles", "again")
    texts = F.broadcast(texts) if (size["cells"] or 0) <= INDEX_CELLS else texts
    both = windows.join(small(near), ["k", "n", "fp"]).join(texts, "no").withColumn("common", F.expr(COMMON))
    union = F.size("win") + F.size("shingles") - F.col("common")
    hits = both.where(100 * F.col("common") >= PERCENT * union).withColumn("similarity", F.col("common") / union)
    best = hits.groupBy(ROW, "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), (-F.col("hamming")).alias("d"))).alias("best"))
    return best.select(ROW, "item", "best.similarity", (-F.col("best.s")).alias("start_word"), (-F.col("best.d")).cast("int").alias("hamming"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, similarity, start_word, hamming): the best window of each document and item that it holds.

    A window has as many 5-word shingles as the item (an item of fewer words is one shingle). Its
    weighted similarity is the multiset Jaccard of the shingles, at least 0.8 to count. Windows are
    fingerprinted by SimHash at every place where a similar one can lie (see ``_windows``, which loses
    none), whatever the item; a multi-index of RADIUS + 1 bit blocks then finds all items of that size
    with a fingerprint within the radius, each distinct fingerprint once, however many documents hold the passage. A
    window at similarity 0.8 lies beyond the radius with probability 0.01, at 0.9 under 1e-4. Then the
    similarity is computed in full.

    Texts are not moved. Null and empty texts and items match nothing; very long texts are read
    whole, and a window is no longer than its item. Rows without an id and rows that repeat an id are documents
    of their own, with a row each; repeated or null item ids act as one item with all their texts; of
    equally similar windows the first counts. Empty tables give an empty result; other columns are not read.
    """
    rows, unique = with_rows(docs, id_col, text_col)
    out = _leaks(rows.select(ROW, F.col(text_col).alias("text")), benchmark, item_id, item_text)
    out = out.withColumn("id", F.col(ROW)) if unique else out.join(rows.select(ROW, F.col(id_col).alias("id")), ROW)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "similarity", "start_word", "hamming")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage; all columns stay, and each row is judged by its own text."""
    rows, _ = with_rows(docs, id_col, text_col)
    bad = _leaks(rows.select(ROW, F.col(text_col).alias("text")), benchmark, "item_id", "text").select(ROW).distinct()
    return rows.join(bad, ROW, "left_anti").select(*docs.columns)
