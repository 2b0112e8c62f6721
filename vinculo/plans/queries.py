"""Registered queries over the portfolio that the driver's tables yield."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculo.functions.columns import CLIENT_STATES, distinct_values, standard_state
from vinculo.functions.runtime import materialize, shared_dir
from vinculo.functions.strong import reach_counts, strong_components
from vinculo.operators import acquisition, exposure, graph, quality, scoring
from vinculo.plans.portfolio import Portfolio
from vinculo.sources import readers, sinks
from vinculo.sources.schemas import LABELS

Query = Callable[[SparkSession, str], DataFrame]


def on(f: Callable[[Portfolio], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(Portfolio(spark, sf_dir))


def raw_tables(p: Portfolio) -> dict[str, DataFrame]:
    return {"clientes": p.clientes, "empresas": p.empresas, "prestamos": p.prestamos, "garantias": p.garantias, "relaciones": p.relaciones}


def etl(p: Portfolio) -> quality.Validated:
    return quality.run_etl(raw_tables(p))


def ties(p: Portfolio) -> DataFrame:
    return p.relaciones.where(F.col("tipo_relacion").isin("ACCIONISTA", "DIRECTOR"))


def shares(p: Portfolio) -> DataFrame:
    return p.relaciones.where("tipo_relacion = 'ACCIONISTA'").select(F.col("id_individuo").alias("source"), F.col("id_empresa").alias("target"))


def joined(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn(c, F.array_join(c, ","))


def edges_of(p: Portfolio) -> tuple[DataFrame, DataFrame]:
    return graph.graph_nodes(p.clientes, p.empresas, p.prestamos), graph.graph_edges(p.clientes, p.empresas, p.prestamos, p.garantias, p.relaciones)


def circular_3(p: Portfolio) -> DataFrame:
    balances = graph.open_balance(p.prestamos).select(F.col("id").alias("node"), (F.col("c") / F.lit(100.0)).alias("balance"))
    return graph.circular_3(graph.guarantee_adjacency(p.garantias, p.prestamos), balances).fillna(0.0, ["balance_a", "balance_b", "balance_c"])


def ownership_components(p: Portfolio) -> DataFrame:
    rels = ties(p).select(F.col("id_individuo").alias("person_id"), F.col("id_empresa").alias("company_ref"))
    return graph.component_sizes(*graph.bipartite(rels.select("person_id"), rels))


def statements(p: Portfolio) -> tuple[DataFrame, DataFrame]:
    rows = ties(p)
    names = rows.select(F.col("id_relacion").alias("statement_id"), F.col("id_individuo").alias("fullname"))
    return names, rows.select(F.col("id_relacion").alias("statement_id"), F.lit("").alias("birthdate"), F.col("id_empresa").alias("company_ref"))


def controllers(p: Portfolio) -> DataFrame:
    return acquisition.multi_company_controllers(*statements(p))


def director_controllers(p: Portfolio) -> DataFrame:
    return acquisition.find_controllers(*statements(p), p.relaciones.where("tipo_relacion = 'DIRECTOR'").select("id_individuo"))


def cycle_routes(p: Portfolio) -> DataFrame:
    found = graph.render_path(graph.cycles(graph.guarantee_adjacency(p.garantias, p.prestamos), 6), edges_of(p)[0])
    return joined(found.withColumn("route", F.array_join("route", " > ")), "nodes")


def client_states(p: Portfolio) -> DataFrame:
    state = standard_state(F.col("estado_residencia"), CLIENT_STATES)
    return distinct_values(p.clientes.select(state.alias("estado_residencia")), "estado_residencia")


def companies_appended(p: Portfolio) -> DataFrame:
    """The companies, and one more of each nation after them."""
    new = p.table("nation").select(F.col("n_name").alias("razon_social"), "n_nationkey")
    return acquisition.append_companies(p.empresas, new, ["razon_social", "n_nationkey"], 7).select("id_empresa", "razon_social")


def corporate_groups(p: Portfolio) -> DataFrame:
    rel = p.relaciones.where("tipo_relacion = 'SUBSIDIARIA'").select(F.col("id_individuo").alias("child_lei"), F.col("id_empresa").alias("parent_lei"))
    return acquisition.corporate_groups(rel, p.empresas.select(F.col("id_empresa").alias("lei"), F.coalesce("razon_social", F.lit("")).alias("legal_name")))


def borrowers(p: Portfolio) -> DataFrame:
    """One borrower per customer in groups of ten, with fixed linear features and the label of two defaulted loans."""
    k = F.col("c_custkey")
    bad = p.prestamos.where("estatus = 'VENCIDO' AND dias_mora > 90").groupBy(F.col("id_titular").alias("id")).agg(F.count("*").alias("bad"))
    loans = p.prestamos.groupBy(F.col("id_titular").alias("id")).agg(F.count("*").alias("loans"))
    rows = p.table("customer").select(k.alias("borrower_id"), F.expr("c_custkey div 10").alias("group_id"), F.col("c_acctbal").alias("balance"), F.concat(F.lit("CLI-"), F.lpad(k.cast("string"), 7, "0")).alias("id"))
    rows = rows.join(bad, "id", "left").join(loans, "id", "left").fillna(0, ["bad", "loans"])
    lev, cov, cash = F.col("loans") / 10.0, F.col("balance") / 5000.0, (F.col("borrower_id") % 7) / 7.0
    from vinculo.functions.columns import stress

    return rows.select("borrower_id", "group_id", "balance", lev.alias("leverage"), cov.alias("interest_coverage"), cash.alias("cash_buffer"), stress(lev, cov, cash).alias("stress"), (F.col("bad") >= 2).cast("int").alias("label"))


def borrower_edges(p: Portfolio) -> DataFrame:
    k = F.col("c_custkey")
    base = p.table("customer").select(k, (F.expr("c_custkey div 10") * 10).alias("g"))
    ring = base.select(k.alias("src"), (F.col("g") + (k % 10 + 1) % 10).alias("dst"))
    return ring.unionByName(base.where(k % 3 == 0).select(k.alias("src"), (F.col("g") + (k % 10 + 2 + k % 7) % 10).alias("dst"))).distinct()


def score_rows(p: Portfolio) -> DataFrame:
    k = F.col("c_custkey")
    return p.table("customer").select((k * 7919 % 97 / 97.0).alias("p"), F.when(k * 31 % 11 < 3, 1).otherwise(0).alias("y"), F.expr("c_custkey div 10").alias("group_id"), F.lit("fixed").alias("model"))


def conditions(p: Portfolio) -> scoring.Conditions:
    """The borrowers with all edges, and with those of the ring alone."""
    rows, edges = borrowers(p), borrower_edges(p)
    ring = edges.where((F.expr("src % 10") + 1) % 10 == F.expr("dst % 10"))
    return {"all_edges": (rows, edges), "ring_edges": (rows, ring)}


SEEDS = [1, 3]
#: Seeds of the fitted runs, as many as the reference has; under these every part holds both classes on the smallest tables too.
RUN_SEEDS = [1, 3, 4, 6, 7]


def predictions(p: Portfolio) -> DataFrame:
    """Test predictions of the four models for two conditions and five seeds, 150 trees each."""
    return materialize(scoring.run_sweep(conditions(p), RUN_SEEDS))


def experiment(p: Portfolio, table: str) -> DataFrame:
    return scoring.experiment_tables(predictions(p), 20, scoring.sweep_members(conditions(p), RUN_SEEDS))[table]


def strong_guarantees(p: Portfolio) -> DataFrame:
    """Who stands for whom with guarantees of a whole loan."""
    return graph.guarantee_adjacency(p.garantias.where("cobertura_porcentaje = 1.0"), p.prestamos)


def score_history(p: Portfolio) -> DataFrame:
    """Scores of all loans, then a second version of those not paid off, written twice as after a failed job."""
    first = p.prestamos.select("id_prestamo", "probabilidad_incumplimiento", "score_version", "score_fecha")
    second = p.prestamos.where("estatus <> 'PAGADO'").select("id_prestamo", (F.col("probabilidad_incumplimiento") / 2).alias("probabilidad_incumplimiento"), F.lit("v2").alias("score_version"), "score_fecha")
    path = f"{shared_dir(p.spark)}/vinculo-scores-{uuid.uuid4().hex}"
    for scores in (first, second, second):
        sinks.append_scores(scores, path)
    return sinks.read_scores(p.spark, path, first.schema)


def new_folder(p: Portfolio) -> str:
    return f"{shared_dir(p.spark)}/vinculo-landed-{uuid.uuid4().hex}"


def loans_from_csv(p: Portfolio) -> DataFrame:
    """The loans written as CSV and read with their schema."""
    path = new_folder(p)
    sinks.write_csv(p.prestamos.withColumn("_helper", F.lit(1)), path)
    return readers.read_raw(p.spark, path, "prestamos").select("id_prestamo", "id_titular", "estatus", "monto_original_mxn", "saldo_vigente_mxn", "dias_mora")


def clean_from_store(p: Portfolio) -> DataFrame:
    """Rows of the clean layer as written and read back, by entity."""
    path, clean = new_folder(p), etl(p).clean
    for entity, df in clean.items():
        sinks.write_clean(df, path, entity)
    counts = [readers.read_clean(p.spark, path, e).agg(F.count("*").alias("n")).select(F.lit(LABELS[e]).alias("entity_type"), "n") for e in clean]
    return reduce(DataFrame.unionByName, counts)


def rejects_from_store(p: Portfolio) -> DataFrame:
    """The audit as written by entity and read back."""
    path = new_folder(p)
    sinks.write_rejected(quality.audit(etl(p)), path)
    return p.spark.read.parquet(path).select("id", "entity_type", "rejection_reasons")


def registry_companies(p: Portfolio) -> DataFrame:
    """Companies landed as registry pages of 200 items, read in splits; those with staff are active."""
    named = lambda name, c: F.struct(F.col(c).alias(name)) if isinstance(c, str) else F.struct(c.alias(name))
    status = F.when(F.col("num_empleados").isNotNull(), "ACTIVE").otherwise("INACTIVE")
    address = F.struct(F.lit("MX").alias("country"), F.concat(F.lit("MX-"), "estado_registro").alias("region"))
    entity = F.struct(named("name", "razon_social").alias("legalName"), status.alias("status"), address.alias("legalAddress"))
    item = named("attributes", F.struct(F.col("id_empresa").alias("lei"), entity.alias("entity")))
    page = F.expr("cast(substring(id_empresa, 5) as bigint) div 200")
    path = new_folder(p)
    sinks.write_json(p.empresas.groupBy(page.alias("page")).agg(F.collect_list(item).alias("data")).select("data"), path)
    found = readers.filter_entities(readers.flatten_entities(readers.read_registry_items(p.spark, path)))
    return found.select("lei", "legal_name", "address_region")


def stored_hops(p: Portfolio) -> str:
    """The guarantee hops as bucketed tables; their name."""
    name = f"vinculo_hops_{uuid.uuid4().hex}"
    sinks.store_hops(graph.hops_with_loans(p.garantias, p.prestamos), name, shared_dir(p.spark), 8)
    return name


def reach_from_hubs(p: Portfolio) -> DataFrame:
    """All that the ten guarantors of most debtors stand for, at any distance."""
    adj = graph.guarantee_adjacency(p.garantias, p.prestamos)
    hubs = adj.groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").limit(10).select("src")
    return graph.reachable(adj, hubs)


QUERIES: dict[str, Query] = {
    "portfolio_overview": on(lambda p: exposure.portfolio_overview(p.prestamos)),
    "exposure_by_type": on(lambda p: exposure.exposure_by_type(p.prestamos)),
    "exposure_by_sector": on(lambda p: exposure.exposure_by_sector(p.prestamos, p.empresas)),
    "status_mix": on(lambda p: exposure.status_mix(p.prestamos)),
    "unsecured_active": on(lambda p: exposure.unsecured_active(p.prestamos, p.garantias)),
    "unsecured_high_risk": on(lambda p: exposure.unsecured_high_risk(p.prestamos, p.garantias)),
    "direct_exposure": on(lambda p: exposure.direct_exposure(p.prestamos, p.clientes, 100000, 0.5)),
    "top_by_pd": on(lambda p: exposure.top_by_pd(p.prestamos)),
    "pd_by_version": on(lambda p: exposure.pd_by_version(p.prestamos)),
    "verify_scores": on(lambda p: exposure.verify_scores(p.prestamos)),
    "etl_audit": on(lambda p: quality.audit(etl(p))),
    "etl_audit_by_entity": on(lambda p: quality.audit_by_entity(quality.audit(etl(p)))),
    "etl_audit_by_reason": on(lambda p: quality.audit_by_reason(quality.audit(etl(p)))),
    "etl_conservation": on(lambda p: quality.conservation(etl(p))),
    "etl_clean_loans": on(lambda p: etl(p).clean["prestamos"].select("id_prestamo", "id_titular", "estatus")),
    "etl_issue_counts": on(lambda p: quality.issue_counts(quality.audit(etl(p)))),
    "empresa_flags": on(lambda p: quality.empresa_flags(p.empresas)),
    "demo_high_score": on(lambda p: quality.demo_high_score(p.clientes)),
    "load_validation": on(lambda p: quality.validate_for_load(raw_tables(p))),
    "unique_loan_key": on(lambda p: quality.unique_key(p.prestamos, "id_prestamo")),
    "repeated_curps": on(lambda p: quality.unique_key(p.clientes, "curp")),
    "ingest_report": on(lambda p: quality.ingest_report(etl(p)).drop("reported_at")),
    "over_coverage": on(lambda p: quality.over_coverage(p.garantias)),
    "client_states": on(client_states),
    "graph_counts": on(lambda p: graph.graph_counts(*edges_of(p))),
    "guarantee_adjacency": on(lambda p: graph.guarantee_adjacency(p.garantias, p.prestamos)),
    "reach_4_hops": on(lambda p: graph.reachable(graph.guarantee_adjacency(p.garantias, p.prestamos), max_hops=4)),
    "cycles_to_6": on(lambda p: joined(graph.cycles(graph.guarantee_adjacency(p.garantias, p.prestamos), 6), "nodes")),
    "circular_3": on(circular_3),
    "guarantee_chain": on(lambda p: graph.guarantee_chain(p.garantias, p.prestamos)),
    "guarantee_chain_stored": on(lambda p: graph.stored_chain(p.spark, stored_hops(p))),
    "guarantee_adjacency_stored": on(lambda p: graph.stored_adjacency(p.spark, stored_hops(p))),
    "guarantors_of_debtors": on(lambda p: graph.guarantors_of(p.garantias, p.prestamos)),
    "guarantor_figures": on(lambda p: graph.guarantor_figures(p.garantias, p.prestamos)),
    "cycle_routes": on(cycle_routes),
    "connected_exposure": on(lambda p: graph.connected_exposure(p.relaciones, p.prestamos)),
    "shared_controllers": on(lambda p: joined(graph.shared_controllers(shares(p)), "companies")),
    "shareholder_hubs": on(lambda p: joined(graph.shareholder_hubs(shares(p)), "shareholders")),
    "contagion_hub": on(lambda p: graph.contagion_hub(p.relaciones, p.prestamos, p.garantias)),
    "company_loans": on(lambda p: graph.company_loans(p.prestamos, p.empresas)),
    "hub_exposure": on(lambda p: graph.hub_exposure(p.relaciones, p.prestamos)),
    "controller_holdings": on(lambda p: graph.controller_holdings(p.relaciones, p.prestamos)),
    "person_exposure": on(lambda p: graph.person_exposure(p.clientes, p.prestamos)),
    "concentration_risk": on(lambda p: graph.concentration_risk(p.relaciones, p.prestamos)),
    "concentration_all": on(lambda p: graph.concentration_risk(p.relaciones, p.prestamos, 1)),
    "hub_edges": on(lambda p: graph.incident_edges(edges_of(p)[1], graph.shareholder_hubs(shares(p)).select("target"))),
    "party_counts": on(lambda p: graph.party_counts(ties(p))),
    "loans_from_csv": on(loans_from_csv),
    "clean_from_store": on(clean_from_store),
    "rejects_from_store": on(rejects_from_store),
    "registry_companies": on(registry_companies),
    "split_membership": on(lambda p: scoring.split_membership(borrowers(p), [0, 1])),
    "score_history": on(lambda p: exposure.pd_by_version(score_history(p))),
    "not_rescored": on(lambda p: exposure.not_rescored(score_history(p), "v1", "v2")),
    "shared_director_loans": on(lambda p: graph.shared_director_loans(p.relaciones, p.prestamos)),
    "guaranteed_exposure": on(lambda p: graph.guaranteed_exposure(p.garantias, p.prestamos)),
    "contagion_by_guarantor": on(lambda p: graph.contagion_by_guarantor(p.garantias, p.prestamos)),
    "weighted_exposure": on(lambda p: graph.weighted_exposure(p.garantias, p.prestamos)),
    "related_parties": on(lambda p: graph.related_parties(ties(p))),
    "risk_profile": on(lambda p: graph.risk_profile(p.clientes.replace("Ciudad de Mexico", "CDMX", ["estado_residencia"]), p.prestamos, p.garantias, None, 0.5)),
    "default_impact": on(lambda p: graph.default_impact(p.garantias, p.prestamos)),
    "correlated_entities": on(lambda p: graph.correlated_entities(p.relaciones, p.garantias, p.prestamos)),
    "portfolio_gap": on(lambda p: graph.portfolio_gap(p.prestamos, p.garantias, p.relaciones)),
    "ownership_components": on(ownership_components),
    "degree_histogram": on(lambda p: graph.degree_histogram(ties(p).select("id_individuo", "id_empresa"), "id_individuo")),
    "multi_company_controllers": on(controllers),
    "director_controllers": on(director_controllers),
    "companies_appended": on(companies_appended),
    "largest_components": on(lambda p: graph.components_by_size(ownership_components(p), 10)),
    "corporate_groups": on(corporate_groups),
    "loan_feature_balance": on(lambda p: scoring.class_balance(scoring.loan_features(p.prestamos, p.clientes))),
    "graph_features": on(lambda p: scoring.graph_features(borrowers(p), borrower_edges(p)).select("borrower_id", "relationship_count", "guaranteed_exposure", "connected_financial_stress")),
    "split_counts": on(lambda p: scoring.split_counts(borrowers(p).join(scoring.split_groups(borrowers(p), 0), "group_id"))),
    "class_balance": on(lambda p: scoring.class_balance(borrowers(p).join(scoring.split_groups(borrowers(p), 0), "group_id"), ["split"])),
    "held_out_counts": on(lambda p: scoring.held_out_counts(borrowers(p), [0, 1, 2, 3, 4])),
    "class_weight": on(lambda p: scoring.class_weight(borrowers(p))),
    "score_metrics": on(lambda p: scoring.binary_metrics(score_rows(p), [])),
    "calibration_curve": on(lambda p: scoring.calibration_curve(score_rows(p), ["model"])),
    "classification_report": on(lambda p: scoring.classification_report(score_rows(p))),
    "bootstrap_intervals": on(lambda p: scoring.intervals(scoring.group_bootstrap(score_rows(p), ["model"], 50), ["model"])),
    "experiment_metrics": on(lambda p: scoring.binary_metrics(predictions(p), ["condition", "seed", "model"])),
    "experiment_uplift": on(lambda p: experiment(p, "uplift")),
    "experiment_curves": on(lambda p: scoring.calibration_curve(predictions(p), ["condition", "seed", "model"])),
    "experiment_split_counts": on(lambda p: scoring.split_counts(scoring.sweep_members(conditions(p), SEEDS), by=("condition", "seed"))),
    "reach_counts": on(lambda p: reach_counts(graph.guarantee_adjacency(p.garantias, p.prestamos))),
    "reach_unlimited": on(lambda p: graph.reachable(graph.guarantee_adjacency(p.garantias, p.prestamos))),
    "reach_from_hubs": on(reach_from_hubs),
    "cycles_unbounded": on(lambda p: joined(graph.cycles(strong_guarantees(p)), "nodes")),
    "strong_components": on(lambda p: strong_components(graph.guarantee_adjacency(p.garantias, p.prestamos))),
    "subgraph_stats": on(lambda p: acquisition.subgraph_stats(ties(p).select(F.col("id_individuo").alias("person_id")).distinct(), ties(p).select(F.col("id_individuo").alias("person_id"), F.col("id_empresa").alias("company_ref")))),
}
