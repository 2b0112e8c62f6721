"""Scalar functions of the portfolio: corrections, bands, keys, typed conversion, score transforms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vinculo.functions.prefix import ranked

#: Spellings of states and their standard form, of clients and of companies.
CLIENT_STATES = {"Ciudad de Mexico": "CDMX"}
COMPANY_STATES = {"CMX": "CDMX", "NL": "Nuevo Leon", "JAL": "Jalisco", "MEX": "Estado de Mexico", "QRO": "Queretaro"}
#: Sector of a company by a word in its name, in order of priority.
SECTORS = {"BBVA": "SERVICIOS", "BIMBO": "MANUFACTURA", "BARCEL": "MANUFACTURA", "RICOLINO": "MANUFACTURA", "FONDO": "SERVICIOS"}
#: Coefficients of the stress index for leverage, interest coverage and cash buffer.
STRESS = (0.85, -0.65, -0.45)


def cents(money: str | Column) -> Column:
    """Money as whole cents, so that sums do not depend on their order."""
    return F.round((F.col(money) if isinstance(money, str) else money) * 100).cast("bigint")


def pesos(total_cents: Column) -> Column:
    return F.coalesce(total_cents, F.lit(0)).cast("double") / F.lit(100.0)


def standard_state(c: Column, spellings: dict[str, str]) -> Column:
    """The standard form of a known spelling; any other value stays."""
    known = F.create_map(*[F.lit(x) for pair in spellings.items() for x in pair])
    return F.coalesce(known[c], c)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """The distinct values of a column, in order; null is one of them."""
    return df.select(col).distinct().orderBy(col)


def default_label(strict: bool = False) -> Column:
    """1 for VENCIDO; strictly, only with more than 90 days past due."""
    bad = F.col("estatus") == "VENCIDO"
    return F.when(bad & (F.col("dias_mora") > 90) if strict else bad, 1).otherwise(0)


def size_band(n: Column) -> Column:
    return F.when(n <= 10, "MICRO").when(n <= 50, "PEQUENA").when(n <= 250, "MEDIANA").when(n.isNotNull(), "GRANDE")


def sector_of(name: Column, default: Column | None = None, last: bool = False, sectors: dict[str, str] = SECTORS) -> Column:
    """Sector by the first (or last) listed keyword in the name, else the default."""
    keys = list(sectors.items())
    out = default if default is not None else F.lit("SERVICIOS")
    for word, sector in keys if last else reversed(keys):
        out = F.when(F.upper(name).contains(word), sector).otherwise(out)
    return out


def region_code(c: Column, missing: str = "CMX") -> Column:
    """The code after ``MX-``; ``missing`` where there is no such prefix or no region."""
    return F.when(c.startswith("MX-"), F.regexp_replace(c, "^MX-", "")).otherwise(F.lit(missing))


def company_number(ref: Column) -> Column:
    """The last part of a reference of three or more parts, else all of it."""
    parts = F.split(ref, "-")
    return F.when(F.size(parts) >= 3, F.element_at(parts, -1)).otherwise(ref)


def is_priority(name: Column, keywords: list[str]) -> Column:
    return F.coalesce(F.upper(name).rlike("|".join(re.escape(k.upper()) for k in keywords)), F.lit(False))


def assign_ids(new: DataFrame, prefix: str, order: list[str], existing: DataFrame | None = None, id_col: str = "id", width: int = 5) -> DataFrame:
    """``new`` with ids that go on after the largest existing number, in the given order; ranks come from range partitions."""
    top = existing.agg(F.max(F.split(id_col, "-")[1].cast("int"))).first()[0] if existing is not None else None
    rows = ranked(new.drop(id_col), order, name="__rank")
    return rows.withColumn(id_col, F.concat(F.lit(f"{prefix}-"), F.lpad((F.col("__rank") + (top or 0)).cast("string"), width, "0"))).drop("__rank")


def typed(df: DataFrame, schema: StructType) -> DataFrame:
    """Text columns to the schema's types: empty or malformed becomes null, flags are true for 'true' in any case."""
    out = []
    for f in schema:
        text = F.nullif(F.trim(F.col(f.name).cast("string")), F.lit(""))
        kind = f.dataType.simpleString()
        out.append((F.try_to_date(text) if kind == "date" else F.upper(text) == "TRUE" if kind == "boolean" else text.try_cast(kind)).alias(f.name))
    return df.select(*out)


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-35.0)), F.lit(35.0))))


def stress(leverage: Column, coverage: Column, cash: Column, coefficients: tuple[float, float, float] = STRESS) -> Column:
    """Fixed linear index of financial stress, divided by the coefficients' norm."""
    norm = sum(c * c for c in coefficients) ** 0.5
    return (leverage * coefficients[0] + coverage * coefficients[1] + cash * coefficients[2]) / norm


def expected_loss(pd: Column, exposure: Column, lgd: float = 1.0) -> Column:
    """PD x EAD x LGD; 0.45 for unsecured and 0.25 for secured loans are usual values of LGD."""
    return pd * exposure * lgd
