"""Scenario goldens and their broken copies, sources and sinks, rules, graph and scoring on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from vinculo.functions.columns import CLIENT_STATES, COMPANY_STATES, company_number, region_code, sector_of, size_band, standard_state, stress, typed
from vinculo.functions.components import connected_components
from vinculo.operators import acquisition, exposure, graph, quality, scenarios, scoring
from vinculo.sources import readers, sinks
from vinculo.sources.schemas import raw_schema

# Fixed values of the four scenarios (FIXTURES.md, part A).
LOANS = {"control": [("L01", "C01", 600000), ("L02", "C02", 800000), ("L03", "C03", 400000)], "chain": [("L11", "P11", 90000), ("L12", "P12", 120000), ("L13", "P13", 180000)],
         "cycle": [("L21", "P21", 100000), ("L22", "P22", 120000), ("L23", "P23", 140000)], "hub": [("L31", "C31", 1200000), ("L32", "P31", 150000), ("L33", "P32", 200000), ("L34", "P33", 100000)]}
LINKS = {"control": [("P01", c, "controls") for c in ("C01", "C02", "C03")], "chain": [("P11", "L12", "guarantees"), ("P12", "L13", "guarantees")],
         "cycle": [("P21", "L22", "guarantees"), ("P22", "L23", "guarantees"), ("P23", "L21", "guarantees")],
         "hub": [(p, "C31", "shareholder") for p in ("P31", "P32", "P33")] + [("P31", "L33", "guarantees"), ("P32", "L32", "guarantees")]}
GOLDEN = {"control": (1800000, 3, 3), "chain": (390000, 3, 3), "cycle": (360000, 3, 3), "hub": (1650000, 4, 4)}


@pytest.fixture(scope="module")
def doc(spark):
    loans = [(s, i, b, b, float(a)) for s, x in LOANS.items() for i, b, a in x]
    edges = [(s, *e) for s, x in LINKS.items() for e in x] + [(s, b, i, "owns") for s, x in LOANS.items() for i, b, _ in x]
    ends = sorted({(s, n) for s, a, b, _ in edges for n in (a, b)})
    return {
        "nodes": spark.createDataFrame([(s, n, n, {"P": "person", "C": "company", "L": "loan"}[n[0]]) for s, n in ends], "scenario string, id string, label string, type string"),
        "edges": spark.createDataFrame(edges, "scenario string, source string, target string, type string"),
        "loans": spark.createDataFrame(loans, "scenario string, id string, borrower string, borrower_id string, amount_mxn double"),
        "metrics": spark.createDataFrame([(s, *m) for s, m in GOLDEN.items()], "scenario string, exposure_mxn long, loans long, borrowers long")}


def test_scenarios_are_valid_and_round_trip(spark, doc, tmp_path):
    assert scenarios.validate_document(**doc).count() == 0
    assert all(r.holds for r in scenarios.validate_patterns(doc["edges"], doc["loans"]).collect())
    got = {r.scenario: (r.exposure_mxn, r.loans, r.borrowers) for r in exposure.exposure_metrics(doc["loans"], ["scenario"]).collect()}
    assert got == GOLDEN
    sinks.write_json(sinks.scenario_document(**doc), str(tmp_path / "doc"))
    again = readers.read_scenarios(spark, str(tmp_path / "doc"))
    for name, df in doc.items():
        assert sorted(map(str, again[name].select(*df.columns).collect())) == sorted(map(str, df.collect()))


def test_broken_scenarios_are_reported(spark, doc):
    bad = lambda **x: {r.violation for r in scenarios.validate_document(**(doc | x)).collect()}
    assert "dangling edge end" in bad(edges=doc["edges"].union(spark.createDataFrame([("hub", "P31", "missing", "controls")])))
    assert "duplicate node" in bad(nodes=doc["nodes"].union(doc["nodes"].limit(1)))
    more = lambda a: doc["loans"].union(spark.createDataFrame([("hub", "L34", "P33", "P33", a)]))
    assert {"duplicate loan", "conflicting balances"} <= bad(loans=more(5.0)) and "conflicting balances" not in bad(loans=more(100000.0))
    assert "loan not owned once" in bad(edges=doc["edges"].where("NOT (type = 'owns' AND target = 'L34')"))
    assert "metrics differ" in bad(metrics=doc["metrics"].withColumn("loans", F.col("loans") + 1))
    with pytest.raises(Exception, match="conflicting"):
        exposure.exposure_metrics(more(-1.0), ["scenario"], strict=True).collect()


def test_graph_of_scenarios(spark, doc):
    adj = scenarios.scenario_adjacency(doc["edges"], doc["loans"]).select("src", "dst")
    assert sorted(",".join(r.nodes) for r in graph.cycles(adj).collect()) == ["P21,P22,P23", "P31,P32"]
    assert {r.node for r in graph.reachable(adj, spark.createDataFrame([("P11",)], "s string")).collect()} == {"P12", "P13"}
    assert graph.reachable(adj, spark.createDataFrame([("nobody",)], "s string")).count() == 0
    control = doc["edges"].where("type = 'controls'")
    assert graph.shared_controllers(control.union(control)).first().companies == ["C01", "C02", "C03"]
    one = control.where("target = 'C01'").select("source", "target")
    assert graph.shared_controllers(one.union(one)).count() == 0


def test_long_ring_and_long_chain(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 1000) for i in range(1000)], "src long, dst long")
    assert graph.cycles(ring, 3).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, None)], "u long, v long")
    got = {r.node: r.component for r in connected_components(chain).collect()}
    assert len(got) == 303 and {got[i] for i in range(301)} == {0} and got[1001] == 1000


def test_csv_and_json_sources(spark, tmp_path):
    csv = tmp_path / "c.csv"
    csv.write_text("id_garantia,id_prestamo,id_garante,tipo_garantia,cobertura_porcentaje,fecha_inicio,fecha_vencimiento,activa\nG1,P1,C1,AVAL,abc,2024-01-01,bad,True\nG2,,C1,AVAL,0.5,,,false\n")
    rows = readers.read_raw(spark, str(csv), "garantias").collect()
    assert rows[0].cobertura_porcentaje is None and rows[1].id_prestamo is None and rows[1].cobertura_porcentaje == 0.5
    assert readers.read_csv_strings(spark, str(csv)).first().cobertura_porcentaje == "abc"
    t = typed(readers.read_csv_strings(spark, str(csv)), spark.createDataFrame([], "id_garantia string, fecha_vencimiento date, activa boolean, cobertura_porcentaje double").schema).collect()
    assert t[0].fecha_vencimiento is None and t[0].activa and not t[1].activa
    sinks.write_csv(spark.createDataFrame([(1, 2)], "a int, _b int"), str(tmp_path / "out"))
    assert readers.read_csv_strings(spark, str(tmp_path / "out")).columns == ["a"]
    found = {r.name: r.found for r in readers.check_sources(spark, str(csv), ["c.csv", "d.csv"]).collect()}
    assert found == {"c.csv": True, "d.csv": False}
    with pytest.raises(ValueError, match="zzz"):
        readers.require_columns(spark.range(1), ["id", "zzz"])


def test_registry(spark, tmp_path):
    entity = lambda lei, name, **x: {"attributes": {"lei": lei, "entity": {"legalName": {"name": name}, "status": "ACTIVE", "legalAddress": {"country": "MX", "region": "MX-NLE"}} | x}}
    edge = lambda a, b: {"attributes": {"relationship": {"startNode": {"id": a}, "endNode": {"id": b}, "type": "IS", "status": "ACTIVE"}, "validFrom": "2020"}}
    (tmp_path / "e.json").write_text(json.dumps({"data": [entity("A", "BIMBO UNO"), entity("B", "HIJO FONDO"), entity("C", "HIJO DOS"), entity("D", "HIJO BARCEL FONDO"), entity("E", "X", status="LAPSED")]}))
    (tmp_path / "r.json").write_text(json.dumps({"data": [edge("B", "A"), edge("B", "A"), edge("C", "A"), edge("D", "A"), edge("A", "Z")]}))
    e = readers.flatten_entities(readers.read_registry_pages(spark, str(tmp_path / "e.json")))
    r = readers.flatten_relationships(readers.read_registry_pages(spark, str(tmp_path / "r.json")))
    assert e.where("lei = 'A'").first().address_city == "" and readers.filter_entities(e).count() == 4
    groups = acquisition.corporate_groups(r, e)
    assert [tuple(x) for x in groups.collect()] == [("A", 3, 3)]
    firms, ties = acquisition.hierarchy_layer(r, e, groups)
    assert {x.lei: (x.id_empresa, x.sector) for x in firms.collect()} == {"A": ("EMP-00001", "MANUFACTURA"), "B": ("EMP-00002", "SERVICIOS"), "C": ("EMP-00003", "MANUFACTURA"), "D": ("EMP-00004", "SERVICIOS")}
    assert ties.count() == 3


def test_ownership_selection(spark):
    persons = spark.createDataFrame([(f"p{i}",) for i in range(6)], "person_id string")
    rels = spark.createDataFrame([("p0", "c1"), ("p1", "c1"), ("p2", "c1"), ("p2", "c2"), ("p3", "c3"), ("p4", "c4"), ("p4", "c5"), ("p4", "c6")], "person_id string, company_ref string")
    firms, who = acquisition.select_subgraph(persons, rels, 2, 4)
    assert {r[0] for r in firms.collect()} == {"c1", "c2"} and {r[0] for r in who.collect()} == {"p0", "p1", "p2", "p4"}
    s = acquisition.subgraph_stats(persons, rels).first()
    assert (s.persons, s.companies, s.edges, s.components, s.largest_component, s.shared_companies, s.max_companies) == (6, 6, 8, 4, 5, 1, 3)


def test_rule_boundaries(spark):
    raw = spark.createDataFrame([(str(i), n, c, b, inc, sc) for i, (n, c, b, inc, sc) in enumerate([
        ("Ana", "A" * 18, "2008-03-15", 0.0, 300.0), ("N/A", None, "1990-01-01", None, 850.0), ("  ", None, "bad", 1.0, None), ("PRUEBA X", "B" * 15, "2027-01-01", -1.0, 299.9), ("Eva", "C" * 18, "2010-01-01", 1.0, 850.1), ("Leo", "C" * 18, None, 1.0, 400.0)])],
        "id_cliente string, nombre_completo string, curp string, fecha_nacimiento string, nivel_ingresos double, score_buro double")
    clean, bad = quality.validate_and_split(raw, quality.clientes_rules())
    assert {r.id_cliente for r in clean.collect()} == {"0", "1"}
    why = {r.id_cliente: r.rejection_reasons for r in bad.collect()}
    assert why == {"2": "null_name", "3": "placeholder_name | invalid_curp_length | future_birthdate | minor | negative_income | score_out_of_range", "4": "duplicate_curp | minor | score_out_of_range", "5": "duplicate_curp"}
    assert "1" in {r.id_cliente for r in quality.validate_and_split(raw, quality.clientes_rules("strict"))[1].collect()}


def test_unknown_relation_types_are_kept_as_rejects(spark):
    empty = {e: spark.createDataFrame([], raw_schema(e)) for e in ("clientes", "empresas", "prestamos", "garantias")}
    rel = spark.createDataFrame([("R1", "X", "Y", "APODERADO", None, None, None, "True"), ("R2", "X", "Y", None, None, None, None, "True")], raw_schema("relaciones"))
    v = quality.run_etl(empty | {"relaciones": rel})
    assert all("unknown_relation_type" in r.rejection_reasons for r in v.rejected["relaciones"].collect())
    assert {r.status for r in quality.conservation(v).collect()} == {"PASS"}


def test_column_functions(spark):
    df = spark.createDataFrame([("MX-NLE", "A-1", "uno bimbo fondo", 10), (None, "A-B-7", None, 251)], "r string, ref string, name string, n int")
    rows = df.select(region_code(F.col("r")).alias("r"), company_number(F.col("ref")).alias("ref"), sector_of(F.col("name")).alias("a"), sector_of(F.col("name"), F.lit("Z"), last=True).alias("b"), size_band(F.col("n")).alias("n")).collect()
    assert [tuple(r) for r in rows] == [("NLE", "A-1", "MANUFACTURA", "SERVICIOS", "MICRO"), ("CMX", "7", "SERVICIOS", "Z", "GRANDE")]


def test_states_of_clients_and_companies_are_mapped_apart(spark):
    df = spark.createDataFrame([("NL",), ("Ciudad de Mexico",), ("PUE",), (None,)], "s string")
    got = df.select(standard_state(F.col("s"), CLIENT_STATES).alias("a"), standard_state(F.col("s"), COMPANY_STATES).alias("b")).collect()
    assert [tuple(r) for r in got] == [("NL", "Nuevo Leon"), ("CDMX", "Ciudad de Mexico"), ("PUE", "PUE"), (None, None)]


def test_stress_index(spark):
    got = spark.range(1).select(stress(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("a"), stress(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("b")).first()
    norm = (0.85**2 + 0.65**2 + 0.45**2) ** 0.5
    assert got.a == pytest.approx(0.85 / norm) and got.b == pytest.approx((0.85 - 1.3 - 1.35) / norm)


def test_neighbours_features_follow_outgoing_edges(spark):
    b = spark.createDataFrame([(1, 0, 10.0, 1.0), (2, 0, 20.0, 3.0), (3, 0, 30.0, 5.0)], "borrower_id int, group_id int, balance double, stress double")
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "src int, dst int")
    got = {r.borrower_id: (r.relationship_count, r.guaranteed_exposure, r.connected_financial_stress) for r in scoring.graph_features(b, e).collect()}
    assert got == {1: (2, 50.0, 4.0), 2: (1, 30.0, 5.0), 3: (0, 0.0, None)}


def test_calibration_uses_only_calibration_outcomes(spark):
    """The test rows' outcomes do not move their calibrated scores; the calibration rows' outcomes do."""
    rows = lambda ys: spark.createDataFrame([(i, y, (i % 10 + 1) / 12.0) for i, y in enumerate(ys)], "id int, label int, p double")
    cal, other = rows([i % 3 == 0 for i in range(60)] and [int(i % 3 == 0) for i in range(60)]), rows([int(i % 3 != 0) for i in range(60)])
    score = lambda c, t: [r.p_calibrated for r in scoring.calibrate(c, t).orderBy("id").collect()]
    one = score(cal, rows([0] * 59 + [1]))
    assert one == score(cal, rows([1] * 59 + [0])) and one != score(other, rows([0] * 59 + [1]))


def test_experiment_tables(spark, tmp_path):
    """Means, paired intervals and the best model, from predictions of two seeds of which one model is always right."""
    rows = [("c", s, m, i, i // 2, i % 2, 0.1 + 0.8 * (i % 2) if m == "gbt_graph" else 0.5) for s in (1, 2) for m in ("gbt", "gbt_graph") for i in range(20)]
    pred = spark.createDataFrame(rows, "condition string, seed int, model string, borrower_id int, group_id int, y int, p double")
    t = scoring.experiment_tables(pred, 10)
    sinks.write_experiment(t, str(tmp_path))
    up = {r.metric: r for r in spark.read.parquet(f"{tmp_path}/uplift").collect()}
    assert up["roc_auc"]["mean"] == up["roc_auc"].low == up["roc_auc"].high == 0.5 and up["brier"]["mean"] == pytest.approx(-0.24)
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/best").collect()] == [("c", "gbt_graph", 1.0)]
    assert {(r.seed, r.model): r.roc_auc for r in spark.read.parquet(f"{tmp_path}/runs").collect()} == {(s, m): a for s in (1, 2) for m, a in (("gbt", 0.5), ("gbt_graph", 1.0))}


def test_metrics_and_splits(spark):
    pred = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.9), ("a", 1, 0.4), ("a", 0, 0.1), ("b", 1, 0.5), ("b", 0, 0.5)], "run string, y int, p double")
    m = {r.run: r for r in scoring.binary_metrics(pred, ["run"]).collect()}
    assert m["a"].roc_auc == pytest.approx((0.5 + 1 + 0 + 1) / 4) and m["b"].roc_auc == 0.5 and m["b"].average_precision == 0.5 and m["b"].brier == 0.25
    assert m["a"].average_precision == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3, abs=1e-6)
    groups = spark.range(100).select((F.col("id") % 20).alias("group_id"), F.col("id").alias("borrower_id"))
    s = scoring.split_groups(groups, 3).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in s} == {"train": 12, "calibration": 4, "test": 4}
    one = spark.createDataFrame([(1, 1, 0.5, "m"), (2, 1, 0.6, "m")], "group_id int, y int, p double, model string")
    with pytest.raises(ValueError, match="both classes"):
        scoring.group_bootstrap(one, ["model"], 5)


def test_features_are_an_allowlist():
    assert not {"label", "future_default", "group_id", "borrower_id"} & set(scoring.feature_names(True))


def test_scores_replace_only_their_loans(spark):
    pre = spark.createDataFrame([("a", 0.1, "v1", "2026-01-01"), ("b", 0.2, "v1", "2026-01-01")], "id_prestamo string, probabilidad_incumplimiento double, score_version string, score_fecha string")
    new = spark.createDataFrame([("a", 0.7, "v2", "2026-02-01", "gbt")], "id_prestamo string, probabilidad_incumplimiento double, score_version string, score_fecha string, model_name string")
    got = {r.id_prestamo: (r.probabilidad_incumplimiento, r.score_version) for r in exposure.apply_scores(pre, new).collect()}
    assert got == {"a": (0.7, "v2"), "b": (0.2, "v1")}
    history = pre.unionByName(new.drop("model_name"))
    assert [r[0] for r in exposure.not_rescored(history, "v1", "v2").collect()] == ["b"]
