"""Vectors as whole numbers: which are usable, and their scaled floors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled components from here on are refused, as squared distances could leave 64 bits.
LARGEST = 1 << 26


def usable(vector: Column) -> Column:
    """True for a vector without null and non-finite components, false for any other and for none."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, all floors downward; one of LARGEST or more is an error."""

    def one(x: Column) -> Column:
        y = x.cast("double") * float(scale)
        return F.when(F.abs(y) < LARGEST, F.floor(y)).otherwise(F.raise_error(F.lit(f"a scaled component is {LARGEST} or more")).cast("bigint"))

    return F.transform(vector, one)


def whole_vectors(df: DataFrame, scale: int, vector_col: str, **columns: str) -> DataFrame:
    """(columns.., v): the usable rows with their whole numbers; ``columns`` maps new names to columns of ``df``."""
    return df.where(usable(F.col(vector_col))).select(*[F.col(c).alias(n) for n, c in columns.items()], whole(F.col(vector_col), scale).alias("v"))
