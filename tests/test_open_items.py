"""Routes, lookups, appended companies and counts on small tables."""

from vinculo.functions.columns import distinct_values
from vinculo.operators import acquisition, exposure, graph


def test_routes_keep_order_and_fall_back_to_the_id(spark):
    paths = spark.createDataFrame([(["c", "a", "b"], 1), (["c", "a", "b"], 2), ([], 3)], "nodes array<string>, k int")
    nodes = spark.createDataFrame([("a", "Ana"), ("b", None), ("x", "Xe")], "id string, name string")
    got = {r.k: r.route for r in graph.render_path(paths, nodes).collect()}
    assert got == {1: ["c", "Ana", "b"], 2: ["c", "Ana", "b"], 3: None}


def test_controllers_by_list_and_by_table(spark):
    names = spark.createDataFrame([("s1", "A"), ("s2", "A"), ("s3", "B"), ("s4", "B"), ("s5", "C")], "statement_id string, fullname string")
    says = spark.createDataFrame([("s1", "", "f"), ("s2", "", "g"), ("s3", "", "f"), ("s4", "", "f"), ("s5", "", "g")], "statement_id string, birthdate string, company_ref string")
    by_list = acquisition.find_controllers(names, says, ["A", "B", "none"]).collect()
    assert [(r.fullname, r.company_count) for r in by_list] == [("A", 2)]
    wanted = spark.createDataFrame([("B",), ("C",), ("C",), (None,)], "n string")
    assert {(r.fullname, r.company_count) for r in acquisition.find_controllers(names, says, wanted, least=1).collect()} == {("B", 1), ("C", 1)}


def test_guarantors_of_a_loan(spark):
    """c's loan is backed by b, b's by a and by c; nobody stands behind their own debt."""
    loans = spark.createDataFrame([("L1", "c", 5.0, 0.2), ("L2", "b", 7.0, 0.4)], "id_prestamo string, id_titular string, saldo_vigente_mxn double, probabilidad_incumplimiento double")
    gar = spark.createDataFrame([("G1", "b", "L1"), ("G2", "a", "L2"), ("G3", "c", "L2"), ("G4", None, "L2"), ("G5", "a", "none")], "id_garantia string, id_garante string, id_prestamo string")
    got = {(r.debtor, r.guarantor, r.depth, r.id_prestamo, r.balance, r.pd) for r in graph.guarantor_figures(gar, loans).collect()}
    assert got == {("c", "b", 1, "L1", 5.0, 0.2), ("c", "a", 2, "L1", 5.0, 0.2), ("b", "a", 1, "L2", 7.0, 0.4), ("b", "c", 1, "L2", 7.0, 0.4)}


def test_appended_companies_go_on_after_the_last_id(spark):
    old = spark.createDataFrame([("EMP-00007", "Old", 3)], "id_empresa string, razon_social string, num_empleados int")
    new = spark.createDataFrame([("Zeta", "x"), ("Alfa", "y")], "razon_social string, extra string")
    got = acquisition.append_companies(old, new, ["razon_social"]).collect()
    assert sorted(map(tuple, got)) == [("EMP-00007", "Old", 3), ("EMP-00008", "Alfa", None), ("EMP-00009", "Zeta", None)]


def test_counts_and_orders(spark):
    loans = spark.createDataFrame([("a", 0.5, "v1"), ("b", 0.5, "v1"), ("c", None, "v1"), ("d", 0.9, None)], "id_prestamo string, probabilidad_incumplimiento double, score_version string")
    assert [tuple(r) for r in exposure.verify_scores(loans, 2).orderBy("id_prestamo").collect()] == [("a", 0.5, "v1", 3), ("b", 0.5, "v1", 3)]
    sizes = spark.createDataFrame([("x", 2), ("b", 5), ("a", 5)], "component string, size int")
    assert [r.component for r in graph.components_by_size(sizes).collect()] == ["a", "b", "x"]
    assert [r.s for r in distinct_values(spark.createDataFrame([("NL",), (None,), ("NL",)], "s string"), "s").collect()] == [None, "NL"]
