"""Portfolio figures over loans, and loan figures in which every loan counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vinculo.functions.columns import cents, expected_loss, pesos
from vinculo.functions.prefix import match, quantiles

OPEN = ("ACTIVO", "REESTRUCTURADO")


def is_open():
    return F.col("estatus").isin(*OPEN)


def portfolio_overview(pre: DataFrame) -> DataFrame:
    """Count, balance, mean balance, loans by status, and the share of VENCIDO in percent."""
    by = {s: F.count_if(F.col("estatus") == s) for s in ("ACTIVO", "PAGADO", "VENCIDO", "REESTRUCTURADO")}
    total = F.sum(cents("saldo_vigente_mxn"))
    return pre.agg(
        F.count("*").alias("loans"), pesos(total).alias("balance"), F.round(pesos(total) / F.greatest(F.count("saldo_vigente_mxn"), F.lit(1)), 6).alias("mean_balance"),
        *[n.alias(s.lower()) for s, n in by.items()], F.round(100.0 * by["VENCIDO"] / F.greatest(F.count("*"), F.lit(1)), 6).alias("npl_percent"))


def exposure_by_type(pre: DataFrame) -> DataFrame:
    return pre.where(is_open()).groupBy("tipo_titular").agg(F.count("*").alias("loans"), pesos(F.sum(cents("saldo_vigente_mxn"))).alias("exposure"))


def exposure_by_sector(pre: DataFrame, emp: DataFrame) -> DataFrame:
    rows = pre.where(is_open()).join(emp.select("id_empresa", "sector"), F.col("id_titular") == F.col("id_empresa"))
    return rows.groupBy("sector").agg(F.count("*").alias("loans"), F.countDistinct("id_empresa").alias("companies"), pesos(F.sum(cents("saldo_vigente_mxn"))).alias("exposure"))


def status_mix(pre: DataFrame) -> DataFrame:
    """Loans by borrower type and status with the share of all loans."""
    n = pre.groupBy("tipo_titular", "estatus").agg(F.count("*").alias("loans"))
    return n.withColumn("share", F.round(F.col("loans") / F.sum("loans").over(Window.partitionBy()), 6))


def unsecured(pre: DataFrame, gar: DataFrame) -> DataFrame:
    """Loans without any guarantee."""
    return pre.join(gar.where("id_prestamo is not null").select("id_prestamo").distinct(), "id_prestamo", "left_anti")


def unsecured_active(pre: DataFrame, gar: DataFrame) -> DataFrame:
    return unsecured(pre.where("estatus = 'ACTIVO'"), gar).agg(F.count("*").alias("loans"), pesos(F.sum(cents("saldo_vigente_mxn"))).alias("exposure"))


def unsecured_high_risk(pre: DataFrame, gar: DataFrame, rate: float | None = 0.30, pd: float | None = None) -> DataFrame:
    """Active loans without guarantee, with a rate or a PD above the limit that is given."""
    rows = pre.where("estatus = 'ACTIVO'")
    rows = rows.where(F.col("tasa_interes_anual") > rate) if rate is not None else rows
    rows = rows.where(F.col("probabilidad_incumplimiento") > pd) if pd is not None else rows
    return unsecured(rows, gar).select("id_prestamo", "id_titular", "saldo_vigente_mxn", "tasa_interes_anual", "probabilidad_incumplimiento")


def direct_exposure(pre: DataFrame, cli: DataFrame, min_balance: float, min_pd: float, lgd: float = 1.0) -> DataFrame:
    """Open loans of persons above a balance and a PD, with expected loss."""
    rows = pre.where(is_open() & (F.col("saldo_vigente_mxn") > min_balance) & (F.col("probabilidad_incumplimiento") > min_pd)).join(cli.select("id_cliente", "nombre_completo"), F.col("id_titular") == F.col("id_cliente"))
    loss = F.round(expected_loss(F.col("probabilidad_incumplimiento"), F.col("saldo_vigente_mxn"), lgd), 4)
    return rows.select("id_cliente", "nombre_completo", "id_prestamo", "saldo_vigente_mxn", "probabilidad_incumplimiento", loss.alias("expected_loss"))


def pd_distribution(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by.., n, mean, stddev, min, median, max) of the scores; the median is exact."""
    p, by = F.col("probabilidad_incumplimiento"), by or []
    figures = scores.groupBy(*by).agg(F.count(p).alias("n"), F.round(F.mean(p), 6).alias("mean"), F.round(F.stddev(p), 6).alias("stddev"), F.min(p).alias("min"), F.max(p).alias("max"))
    middle = quantiles(scores, "probabilidad_incumplimiento", [0.5], by, "q")
    return match(figures, middle, by, "left").select(*by, "n", "mean", "stddev", "min", F.col("q")[0].alias("median"), "max")


def pd_by_version(scores: DataFrame) -> DataFrame:
    return pd_distribution(scores, ["score_version"])


def not_rescored(scores: DataFrame, old: str, new: str) -> DataFrame:
    """Loans scored with version ``old`` and not with ``new``."""
    of = lambda v: scores.where(F.col("score_version") == v).select("id_prestamo").distinct()
    return of(old).join(of(new), "id_prestamo", "left_anti")


def apply_scores(pre: DataFrame, scores: DataFrame) -> DataFrame:
    """Loans with the fields of their latest new score; other loans keep theirs."""
    latest = scores.withColumn("rn", F.row_number().over(Window.partitionBy("id_prestamo").orderBy(F.desc("score_fecha"), F.desc("score_version")))).where("rn = 1")
    fields = ["probabilidad_incumplimiento", "score_version", "score_fecha"]
    new = latest.select("id_prestamo", "model_name", *[F.col(f).alias(f"_{f}") for f in fields])
    rows = pre.join(new, "id_prestamo", "left")
    return rows.withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])


def top_by_pd(pre: DataFrame, n: int = 10) -> DataFrame:
    """The n loans of highest PD; ties go to the smaller id."""
    return pre.where("probabilidad_incumplimiento is not null").orderBy(F.desc("probabilidad_incumplimiento"), "id_prestamo").limit(n).select("id_prestamo", "id_titular", "probabilidad_incumplimiento", "saldo_vigente_mxn")


def verify_scores(pre: DataFrame, n: int = 10) -> DataFrame:
    """The n scored loans of highest PD, ties by id, each with its version and the count of all scored loans."""
    scored = pre.where("score_version is not null")
    top = scored.orderBy(F.desc_nulls_last("probabilidad_incumplimiento"), "id_prestamo").limit(n)
    return top.select("id_prestamo", "probabilidad_incumplimiento", "score_version").join(scored.agg(F.count("*").alias("scored")))  # one row


def exposure_metrics(loans: DataFrame, by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """(by.., exposure_mxn, loans, borrowers, conflicts) over distinct loans(id, borrower_id, amount_mxn).

    A repeated loan counts once. A loan with two balances or borrowers, a negative and a fractional
    balance are conflicts; in strict mode they are an error.
    """
    by = by or []
    loan = loans.groupBy(*by, "id").agg(F.min("amount_mxn").alias("amount"), F.countDistinct(F.struct("borrower_id", "amount_mxn")).alias("forms"), F.min("borrower_id").alias("borrower_id"))
    bad = (F.col("forms") > 1) | F.col("amount").isNull() | (F.col("amount") < 0) | (F.col("amount") != F.floor("amount"))
    out = loan.groupBy(*by).agg(F.coalesce(F.sum(F.floor("amount")), F.lit(0)).cast("bigint").alias("exposure_mxn"), F.count("*").alias("loans"), F.countDistinct("borrower_id").alias("borrowers"), F.count_if(bad).alias("conflicts"))
    if strict:
        out = out.withColumn("exposure_mxn", F.when(F.col("conflicts") > 0, F.raise_error(F.lit("conflicting or invalid loan balances"))).otherwise(F.col("exposure_mxn")))
    return out
