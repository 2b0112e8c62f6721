"""Ranks, running sums and exact quantiles by range partitions and prefix sums, without a window over all rows of a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinculo.functions.runtime import materialize, small

#: Parts whose totals one window sums; a second window sums the totals of so many parts each.
FAN = 1024
_PART_BITS = 33  # of monotonically_increasing_id


def match(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """``a`` joined with the other columns of ``b`` where ``names`` are equal, nulls included; without names every row meets every row of ``b``."""
    other = b.withColumnsRenamed({n: f"__{n}" for n in names})
    on = reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names], F.lit(True))
    return a.join(other, on, how).drop(*[f"__{n}" for n in names])


def before_parts(totals: DataFrame, part: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """``totals`` (one row per key and part) with ``before``: the sum of ``value`` over a key's earlier parts, 0 for its first.

    Two levels of windows: within runs of FAN part numbers, then over the runs, so a million parts are at most 1,024 rows
    in one task. Null values count as 0.
    """
    keys = keys or []
    t = totals.withColumn("_run", F.expr(f"`{part}` div {FAN}"))
    within = Window.partitionBy(*keys, "_run").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = t.groupBy(*keys, "_run").agg(F.sum(value).alias("_sum"))
    runs = runs.select(*keys, "_run", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_earlier"))
    t = t.withColumn("_own", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return match(t, small(runs), [*keys, "_run"]).select(*totals.columns, (F.col("_earlier") + F.col("_own")).alias("before"))


def _sorted(df: DataFrame, order: list[Column | str], keys: list[str]) -> DataFrame:
    """``df`` range partitioned and sorted, written once, with ``_at`` (part number and position) and ``_part``.

    Ties go to any of their parts, so a value that very many rows share is no single task.
    """
    by = [*keys, *order, "_tie"]
    rows = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    return materialize(rows.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", _PART_BITS))


def ranked(df: DataFrame, order: list[Column | str], keys: list[str] | None = None, name: str = "rank") -> DataFrame:
    """``df`` with a rank from 1 without gaps in ``order`` within ``keys``; rows that tie get any order, so break ties for a repeatable one.

    One range shuffle; positions within a part come from the sorted part itself, and only the counts of parts are summed.
    Null keys are a key of their own; an empty table gives an empty result.
    """
    keys = keys or []
    rows = _sorted(df, order, keys)
    parts = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    parts = before_parts(parts, "_part", "_n", keys)
    return match(rows, small(parts), [*keys, "_part"]).select(*df.columns, (F.col("before") + F.col("_at") - F.col("_first") + 1).alias(name))


def running(df: DataFrame, order: list[Column | str], values: list[str], keys: list[str] | None = None) -> DataFrame:
    """``df`` with ``<value>_upto`` for each of ``values``: its sum over a key's rows up to this one in ``order``.

    ``order`` must tell the rows of a key apart. A window runs within each range part; the parts before it are prefix sums.
    """
    keys = keys or []
    rows = _sorted(df, order, keys)
    up = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out, totals = rows, rows.groupBy(*keys, "_part").agg(*[F.sum(v).alias(v) for v in values])
    offsets = totals.select(*keys, "_part")
    for v in values:
        one = before_parts(totals.select(*keys, "_part", v), "_part", v, keys).withColumnRenamed("before", f"_{v}_before").drop(v)
        offsets = match(offsets, one, [*keys, "_part"])
    out = out.select("*", *[F.sum(v).over(up).alias(f"_{v}_own") for v in values])
    return match(out, small(offsets), [*keys, "_part"]).select(*df.columns, *[(F.col(f"_{v}_before") + F.col(f"_{v}_own")).alias(f"{v}_upto") for v in values])


def quantiles(df: DataFrame, value: str, shares: list[float], keys: list[str] | None = None, name: str = "quantiles") -> DataFrame:
    """(keys.., name): the exact quantiles of ``value`` by linear interpolation, null values left out, one row per key that has a value.

    Equal values are counted first; a quantile is picked where the running count passes its place, so no buffer holds
    a key's values.
    """
    keys = keys or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    upto = materialize(running(counts, [value], ["_n"], keys))
    total = upto.groupBy(*keys).agg(F.sum("_n").alias("_rows"))
    placed = match(upto, small(total), keys)
    at = lambda place: F.max(F.when((F.col("_n_upto") > place) & (F.col("_n_upto") - F.col("_n") <= place), F.col(value).cast("double")))
    out = []
    for share in shares:
        place = F.lit(float(share)) * (F.col("_rows") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        out.append(low + (high - low) * F.max(place - F.floor(place)))
    picked = placed.groupBy(*keys).agg(F.array(*out).alias(name))
    return picked.where(F.col(name)[0].isNotNull())
