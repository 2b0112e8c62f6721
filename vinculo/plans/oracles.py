"""SQL for the registered queries, over the same tables; it begins with the raw and clean tables as common table expressions."""

from __future__ import annotations

RAW = r"""
cli AS (SELECT 'CLI-' || lpad(CAST(k AS VARCHAR), 7, '0') AS id_cliente,
  CASE WHEN k % 37 = 5 THEN NULL WHEN k % 41 = 5 THEN 'N/A' WHEN k % 43 = 5 THEN 'PRUEBA ' || c_name ELSE c_name END AS nombre_completo,
  CASE WHEN k % 29 = 3 THEN 'CURP' || lpad(CAST(k AS VARCHAR), 11, '0') WHEN k % 31 = 1 THEN 'CURP' || lpad(CAST(k - 1 AS VARCHAR), 14, '0') ELSE 'CURP' || lpad(CAST(k AS VARCHAR), 14, '0') END AS curp,
  CASE WHEN k % 97 = 6 THEN DATE '2027-01-01' WHEN k % 89 = 6 THEN DATE '2010-01-01' ELSE DATE '1950-01-01' + CAST((37 * k) % 18000 AS INTEGER) END AS birth,
  CASE WHEN k % 17 = 0 THEN NULL WHEN k % 25 IN (3, 4) THEN 'CDMX' ELSE n_name END AS estado_residencia,
  CASE WHEN k % 23 = 2 THEN NULL ELSE c_acctbal END AS nivel_ingresos, CAST(290 + (7919 * k) % 571 AS DOUBLE) AS score_buro,
  CAST(k % 240 + 1 AS INTEGER) AS antiguedad, CAST(k % 6 AS INTEGER) AS historico
  FROM (SELECT c_custkey AS k, * FROM customer) LEFT JOIN nation ON c_nationkey = n_nationkey),
emp AS (SELECT 'EMP-' || lpad(CAST(k AS VARCHAR), 7, '0') AS id_empresa, CASE WHEN k % 50 = 7 THEN NULL ELSE s_name END AS razon_social,
  CASE WHEN k % 33 = 6 THEN 13 ELSE 12 END AS rfc_len, (['COMERCIO', 'SERVICIOS', 'MANUFACTURA', 'CONSTRUCCION', 'TRANSPORTE'])[k % 5 + 1] AS sector,
  CASE WHEN k % 19 = 3 THEN NULL ELSE (k * 53) % 900 + 1 END AS num_empleados,
  CASE WHEN k % 21 = 4 THEN NULL WHEN k % 21 = 5 THEN 0 ELSE abs(s_acctbal) * 1000 END AS ingresos,
  CASE WHEN k % 4 = 0 THEN (['CMX', 'NL', 'JAL', 'MEX', 'QRO'])[k % 5 + 1] ELSE n_name END AS estado
  FROM (SELECT s_suppkey AS k, * FROM supplier) LEFT JOIN nation ON s_nationkey = n_nationkey),
pre AS (SELECT 'PRE-' || lpad(CAST(k AS VARCHAR), 9, '0') AS id_prestamo,
  CASE WHEN k % 211 = 4 THEN 'CLI-9999999' WHEN k % 10 < 7 THEN 'CLI-' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') ELSE 'EMP-' || lpad(CAST((k // 10) % (SELECT count(*) FROM supplier) AS VARCHAR), 7, '0') END AS id_titular,
  CASE WHEN k % 151 = 3 THEN 'EMPRESA' WHEN k % 10 < 7 THEN 'INDIVIDUAL' ELSE 'EMPRESA' END AS tipo_titular,
  CASE WHEN k % 307 = 5 THEN NULL WHEN k % 401 = 5 THEN -o_totalprice ELSE o_totalprice END AS monto,
  CASE WHEN o_orderstatus = 'F' THEN 0 WHEN k % 113 = 6 THEN (c * 12 + 5) // 10 ELSE (c * (10 + k % 86) + 50) // 100 END AS c,
  CASE WHEN k % 223 = 7 THEN CAST(0.9 AS DOUBLE) ELSE (k % 41 + 5) / CAST(100 AS DOUBLE) END AS tasa,
  CAST(o_orderdate AS DATE) + 9000 AS ini, CAST(o_orderdate AS DATE) + 9000 + CAST(CASE WHEN k % 199 = 8 THEN -30 ELSE 365 * (1 + k % 5) END AS INTEGER) AS fin,
  CASE WHEN o_orderstatus = 'O' THEN 'ACTIVO' WHEN o_orderstatus = 'F' THEN 'PAGADO' WHEN k % 3 = 0 THEN 'VENCIDO' WHEN k % 3 = 1 THEN 'REESTRUCTURADO' ELSE 'ACTIVO' END AS estatus,
  CASE WHEN o_orderstatus = 'P' AND k % 3 = 0 THEN 31 + k % 150 WHEN o_orderstatus = 'P' AND k % 3 = 1 THEN k % 31 WHEN o_orderstatus = 'O' AND k % 127 = 9 THEN 12 ELSE 0 END AS mora,
  (k * 31) % 100 / CAST(100 AS DOUBLE) AS pd
  FROM (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS c, * FROM orders)),
gar AS (SELECT 'GAR-' || lpad(CAST(o AS VARCHAR), 9, '0') AS id_garantia, CASE WHEN o % 173 = 2 THEN 'PRE-999999999' ELSE 'PRE-' || lpad(CAST(o AS VARCHAR), 9, '0') END AS id_prestamo,
  CASE WHEN o % 181 = 2 THEN 'CLI-9999999' ELSE 'CLI-' || lpad(CAST((31 * pk + 17 * sk + 1) % (SELECT count(*) FROM customer) AS VARCHAR), 7, '0') END AS id_garante, 25 + o % 76 AS pct,
  CASE WHEN o % 61 = 1 THEN DATE '2026-01-01' ELSE DATE '2027-06-30' END AS fin, o % 67 <> 1 AS activa
  FROM (SELECT l_orderkey AS o, min(l_suppkey) AS sk, min(l_partkey) AS pk FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R' GROUP BY 1)
  UNION ALL
  SELECT 'GAR-R' || lpad(CAST(c_custkey AS VARCHAR), 8, '0'), p.id, 'CLI-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0'), 100, DATE '2027-06-30', true
  FROM customer LEFT JOIN (SELECT id_titular, min(id_prestamo) AS id FROM pre WHERE estatus IN ('ACTIVO', 'REESTRUCTURADO') GROUP BY 1) p
  ON p.id_titular = 'CLI-' || lpad(CAST(c_custkey - c_custkey % 3 + (c_custkey + 1) % 3 AS VARCHAR), 7, '0') WHERE c_custkey % 30 BETWEEN 9 AND 11),
rel AS (SELECT * FROM (
  WITH s AS (SELECT s_suppkey AS k, greatest((SELECT count(*) FROM supplier) * 3 // 4, 1) AS m, (SELECT count(*) FROM customer) AS nc FROM supplier)
  SELECT 'REL-A' || lpad(CAST(k AS VARCHAR), 7, '0') AS id_relacion, CASE WHEN k % 83 = 9 THEN 'CLI-9999999' ELSE 'CLI-' || lpad(CAST(k % m AS VARCHAR), 7, '0') END AS p, 'EMP-' || lpad(CAST(k AS VARCHAR), 7, '0') AS e, 'ACCIONISTA' AS tipo, (k % 50 + 10) / CAST(100 AS DOUBLE) AS share FROM s
  UNION ALL SELECT 'REL-D' || lpad(CAST(k AS VARCHAR), 7, '0'), 'CLI-' || lpad(CAST((k + 1) % m AS VARCHAR), 7, '0'), 'EMP-' || lpad(CAST(k AS VARCHAR), 7, '0'), 'DIRECTOR', NULL FROM s WHERE k % 5 = 0
  UNION ALL SELECT 'REL-H' || lpad(CAST(10 * k + j AS VARCHAR), 8, '0'), 'CLI-' || lpad(CAST((3 * k + 20 + j) % nc AS VARCHAR), 7, '0'), 'EMP-' || lpad(CAST(k AS VARCHAR), 7, '0'), 'ACCIONISTA', (k % 50 + 10) / CAST(100 AS DOUBLE) FROM s, (VALUES (1), (2)) t(j) WHERE k % 10 = 1
  UNION ALL SELECT 'REL-S' || lpad(CAST(k AS VARCHAR), 7, '0'), 'EMP-' || lpad(CAST(k AS VARCHAR), 7, '0'), CASE WHEN k % 49 = 9 THEN 'EMP-9999999' ELSE 'EMP-' || lpad(CAST(k - k % 5 AS VARCHAR), 7, '0') END, 'SUBSIDIARIA', 1.0 FROM s WHERE k % 5 <> 0))"""

ETL = r"""
tcli AS (SELECT *, list_filter([
  CASE WHEN nombre_completo IS NULL OR trim(nombre_completo) = '' THEN 'null_name' END, CASE WHEN regexp_matches(nombre_completo, '(?i)test|prueba|xxx|pendiente') THEN 'placeholder_name' END,
  CASE WHEN length(curp) <> 18 THEN 'invalid_curp_length' END, CASE WHEN count(*) OVER (PARTITION BY curp) > 1 THEN 'duplicate_curp' END, CASE WHEN birth > DATE '2026-03-15' THEN 'future_birthdate' END,
  CASE WHEN birth > DATE '2008-03-15' THEN 'minor' END, CASE WHEN nivel_ingresos < 0 THEN 'negative_income' END, CASE WHEN score_buro < 300 OR score_buro > 850 THEN 'score_out_of_range' END], lambda x: x IS NOT NULL) AS r FROM cli),
temp AS (SELECT *, CASE WHEN razon_social IS NULL THEN ['null_name'] ELSE [] END AS r FROM emp),
holders AS (SELECT id_cliente AS id FROM tcli WHERE len(r) = 0 UNION ALL SELECT id_empresa FROM temp WHERE len(r) = 0),
tpre AS (SELECT pre.*, list_filter([CASE WHEN id_titular NOT IN (SELECT id FROM holders) THEN 'orphaned_fk' END, CASE WHEN tipo_titular = 'EMPRESA' AND starts_with(id_titular, 'CLI-') THEN 'type_mismatch' END,
  CASE WHEN monto IS NULL THEN 'null_amount' END, CASE WHEN monto < 0 THEN 'negative_amount' END, CASE WHEN c / CAST(100 AS DOUBLE) > monto THEN 'saldo_exceeds_monto' END, CASE WHEN tasa > 0.80 THEN 'usury_rate' END,
  CASE WHEN ini > fin THEN 'start_after_end' END, CASE WHEN mora > 0 AND estatus = 'ACTIVO' THEN 'mora_on_activo' END], lambda x: x IS NOT NULL) AS r FROM pre),
tgar AS (SELECT gar.*, list_filter([CASE WHEN l.id_prestamo IS NULL THEN 'orphaned_loan_fk' END, CASE WHEN id_garante NOT IN (SELECT id FROM holders) THEN 'orphaned_guarantor_fk' END,
  CASE WHEN fin < DATE '2026-03-15' AND activa THEN 'expired_but_active' END, CASE WHEN NOT activa AND fin > DATE '2026-03-15' THEN 'status_date_mismatch' END], lambda x: x IS NOT NULL) AS r
  FROM gar LEFT JOIN (SELECT id_prestamo FROM tpre WHERE len(r) = 0) l ON gar.id_prestamo = l.id_prestamo),
trel AS (SELECT rel.*, list_filter([CASE WHEN (tipo = 'SUBSIDIARIA' AND p NOT IN (SELECT id_empresa FROM temp WHERE len(r) = 0)) OR (tipo <> 'SUBSIDIARIA' AND p NOT IN (SELECT id_cliente FROM tcli WHERE len(r) = 0)) THEN 'orphaned_person_fk' END,
  CASE WHEN e NOT IN (SELECT id_empresa FROM temp WHERE len(r) = 0) THEN 'orphaned_company_fk' END], lambda x: x IS NOT NULL) AS r FROM rel),
allrows AS (SELECT id_cliente AS id, 'CLIENTE' AS entity_type, r FROM tcli UNION ALL SELECT id_empresa, 'EMPRESA', r FROM temp UNION ALL SELECT id_prestamo, 'PRESTAMO', r FROM tpre
  UNION ALL SELECT id_garantia, 'GARANTIA', r FROM tgar UNION ALL SELECT id_relacion, 'RELACION', r FROM trel)"""

GRAPH = r"""
opn AS (SELECT id_titular AS id, count(*) AS n, sum(c) AS c FROM pre WHERE estatus IN ('ACTIVO', 'REESTRUCTURADO') GROUP BY 1),
hops AS (SELECT id_garantia AS edge_id, id_garante AS src, pre.id_titular AS dst, pre.id_prestamo, estatus, mora, c FROM gar JOIN pre USING (id_prestamo)),
adj AS (SELECT DISTINCT src, dst FROM hops), accs AS (SELECT DISTINCT p, e FROM rel WHERE tipo IN ('ACCIONISTA', 'DIRECTOR')),
reach AS (WITH RECURSIVE t(start, node, depth) AS (SELECT src, dst, 1 FROM adj UNION SELECT start, adj.dst, depth + 1 FROM t JOIN adj ON t.node = adj.src WHERE depth < 4)
  SELECT start, node, min(depth) AS depth FROM t WHERE start <> node GROUP BY 1, 2),
cyc AS (WITH RECURSIVE t(root, node, nodes) AS (SELECT src, dst, [src, dst] FROM adj WHERE dst > src UNION ALL SELECT root, adj.dst, list_append(nodes, adj.dst) FROM t JOIN adj ON t.node = adj.src
  WHERE len(nodes) < 6 AND adj.dst > root AND NOT list_contains(nodes, adj.dst)) SELECT len(nodes) AS length, array_to_string(nodes, ',') AS nodes FROM t JOIN adj ON adj.src = t.node AND adj.dst = t.root)"""

M = "/ CAST(100 AS DOUBLE)"


def etl(body: str) -> str:
    return f"WITH {RAW}, {ETL} {body}"


def graph(body: str) -> str:
    more = f", {body[5:]}" if body.startswith("WITH ") else f" {body}"
    return f"WITH {RAW}, {GRAPH}{more}"


OPEN = "estatus IN ('ACTIVO', 'REESTRUCTURADO')"
#: Borrowers with group and label, and the split of their groups.
LABELLED = """b AS (SELECT o_custkey AS k, count(*) AS bad FROM orders WHERE o_orderkey % 211 <> 4 AND o_orderkey % 10 < 7 AND o_orderstatus = 'P' AND o_orderkey % 3 = 0 AND o_orderkey % 150 > 59 GROUP BY 1),
        l AS (SELECT c_custkey // 10 AS g, CASE WHEN bad >= 2 THEN 1 ELSE 0 END AS y FROM customer LEFT JOIN b ON c_custkey = k)"""
SPLIT = """r AS (SELECT g, row_number() OVER (ORDER BY md5('0-' || CAST(g AS VARCHAR)), g) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT g FROM l)),
        s AS (SELECT g, CASE WHEN rn <= floor(n * 0.6) THEN 'train' WHEN rn <= floor(n * 0.8) THEN 'calibration' ELSE 'test' END AS split FROM r)"""

#: All pairs of a start and a node that paths of any length lead to, and the strongly connected components.
EVER = """ever AS (WITH RECURSIVE t(start, node) AS (SELECT src, dst FROM adj UNION SELECT start, adj.dst FROM t JOIN adj ON t.node = adj.src) SELECT start, node FROM t WHERE start <> node),
        ends AS (SELECT src AS node FROM adj UNION SELECT dst FROM adj),
        scc AS (SELECT ends.node, least(ends.node, coalesce(min(y.start), ends.node)) AS component, count(y.start) + 1 AS size FROM ends LEFT JOIN ever x ON x.start = ends.node LEFT JOIN ever y ON y.start = x.node AND y.node = x.start GROUP BY 1)"""
#: Every borrower's score and outcome of the score queries.
SCORED = """p AS (SELECT (c_custkey * 7919) % 97 / CAST(97 AS DOUBLE) AS s, CASE WHEN (c_custkey * 31) % 11 < 3 THEN 1 ELSE 0 END AS y, c_custkey // 10 AS g FROM customer)"""


ORACLES = {
    "portfolio_overview": graph(f"""SELECT count(*) AS loans, sum(c) {M} AS balance, round(sum(c) {M} / count(*), 6) AS mean_balance, count(*) FILTER (estatus = 'ACTIVO') AS activo, count(*) FILTER (estatus = 'PAGADO') AS pagado,
        count(*) FILTER (estatus = 'VENCIDO') AS vencido, count(*) FILTER (estatus = 'REESTRUCTURADO') AS reestructurado, round(CAST(100 AS DOUBLE) * count(*) FILTER (estatus = 'VENCIDO') / count(*), 6) AS npl_percent FROM pre"""),
    "exposure_by_type": graph(f"SELECT tipo_titular, count(*) AS loans, sum(c) {M} AS exposure FROM pre WHERE {OPEN} GROUP BY 1"),
    "exposure_by_sector": graph(f"SELECT sector, count(*) AS loans, count(DISTINCT id_empresa) AS companies, sum(c) {M} AS exposure FROM pre JOIN emp ON id_titular = id_empresa WHERE {OPEN} GROUP BY 1"),
    "status_mix": graph("SELECT tipo_titular, estatus, count(*) AS loans, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM pre GROUP BY 1, 2"),
    "unsecured_active": graph(f"SELECT count(*) AS loans, sum(c) {M} AS exposure FROM pre WHERE estatus = 'ACTIVO' AND NOT EXISTS (SELECT 1 FROM gar WHERE gar.id_prestamo = pre.id_prestamo)"),
    "unsecured_high_risk": graph(f"SELECT id_prestamo, id_titular, c {M} AS saldo_vigente_mxn, tasa AS tasa_interes_anual, pd AS probabilidad_incumplimiento FROM pre WHERE estatus = 'ACTIVO' AND tasa > CAST(0.30 AS DOUBLE) AND NOT EXISTS (SELECT 1 FROM gar WHERE gar.id_prestamo = pre.id_prestamo)"),
    "direct_exposure": graph(f"SELECT id_cliente, nombre_completo, id_prestamo, c {M} AS saldo_vigente_mxn, pd AS probabilidad_incumplimiento, round(pd * (c {M}), 4) AS expected_loss FROM pre JOIN cli ON id_titular = id_cliente WHERE {OPEN} AND c > 10000000 AND pd > CAST(0.5 AS DOUBLE)"),
    "top_by_pd": graph(f"SELECT id_prestamo, id_titular, pd AS probabilidad_incumplimiento, c {M} AS saldo_vigente_mxn FROM pre ORDER BY pd DESC, id_prestamo LIMIT 10"),
    "pd_by_version": graph("SELECT 'v1' AS score_version, count(*) AS n, round(avg(pd), 6) AS mean, round(stddev(pd), 6) AS stddev, min(pd) AS min, median(pd) AS median, max(pd) AS max FROM pre"),
    "etl_audit": etl("SELECT id, entity_type, array_to_string(r, ' | ') AS rejection_reasons FROM allrows WHERE len(r) > 0"),
    "etl_audit_by_entity": etl("SELECT entity_type, count(*) AS rejected FROM allrows WHERE len(r) > 0 GROUP BY 1"),
    "etl_audit_by_reason": etl("SELECT entity_type, reason, count(*) AS n FROM (SELECT entity_type, unnest(r) AS reason FROM allrows) GROUP BY 1, 2"),
    "etl_conservation": etl("SELECT entity_type, count(*) AS raw, count(*) FILTER (len(r) = 0) AS clean, count(*) FILTER (len(r) > 0) AS rejected, 'PASS' AS status FROM allrows GROUP BY 1"),
    "etl_clean_loans": etl("SELECT id_prestamo, id_titular, estatus FROM tpre WHERE len(r) = 0"),
    "etl_issue_counts": etl("SELECT entity_type, reason, count(*) AS n FROM (SELECT entity_type, unnest(r) AS reason FROM allrows) GROUP BY GROUPING SETS ((entity_type), (reason), ())"),
    "empresa_flags": graph("SELECT count(*) FILTER (rfc_len <> 12) AS rfc_length, count(*) FILTER (ingresos IS NULL) AS null_revenue, count(*) FILTER (ingresos = 0) AS zero_revenue, count(*) FILTER (num_empleados IS NULL) AS null_employees FROM emp"),
    "demo_high_score": graph("SELECT id_cliente, nombre_completo, nivel_ingresos / 12 AS ingreso_mensual, score_buro FROM cli WHERE nivel_ingresos IS NOT NULL AND score_buro >= 600"),
    "load_validation": graph("""SELECT 'PRESTAMO' AS entity_type, id_prestamo AS id, 'unknown holder ' || id_titular AS reason FROM pre WHERE id_titular NOT IN (SELECT id_cliente FROM cli UNION ALL SELECT id_empresa FROM emp)
        UNION ALL SELECT 'GARANTIA', id_garantia, CASE WHEN l.id IS NULL THEN 'unknown loan ' || coalesce(gar.id_prestamo, 'null') ELSE 'unknown guarantor ' || id_garante END
        FROM gar LEFT JOIN (SELECT id_prestamo AS id FROM pre WHERE id_titular IN (SELECT id_cliente FROM cli UNION ALL SELECT id_empresa FROM emp)) l ON l.id = gar.id_prestamo WHERE l.id IS NULL OR id_garante NOT IN (SELECT id_cliente FROM cli)
        UNION ALL SELECT 'RELACION', id_relacion, CASE WHEN p NOT IN (SELECT id_cliente FROM cli UNION ALL SELECT id_empresa FROM emp) THEN 'unknown person ' || p ELSE 'unknown company ' || e END
        FROM rel WHERE p NOT IN (SELECT id_cliente FROM cli UNION ALL SELECT id_empresa FROM emp) OR e NOT IN (SELECT id_empresa FROM emp)"""),
    "unique_loan_key": graph("SELECT id_prestamo, count(*) AS n FROM pre GROUP BY 1 HAVING count(*) > 1"),
    "over_coverage": graph("SELECT id_prestamo, CAST(sum(pct) AS BIGINT) AS coverage_percent FROM gar WHERE activa AND id_prestamo IS NOT NULL GROUP BY 1 HAVING sum(pct) > 100"),
    "graph_counts": graph("""SELECT 'ClienteIndividual' AS kind, count(*) AS n FROM cli UNION ALL SELECT 'Empresa', count(*) FROM emp UNION ALL SELECT 'Prestamo', count(*) FROM pre
        UNION ALL SELECT 'TIENE_PRESTAMO', count(*) FROM pre WHERE id_titular IN (SELECT id_cliente FROM cli UNION ALL SELECT id_empresa FROM emp)
        UNION ALL SELECT 'GARANTIZA', count(*) FROM gar WHERE id_garante IN (SELECT id_cliente FROM cli) AND id_prestamo IN (SELECT id_prestamo FROM pre)
        UNION ALL SELECT 'ES_' || tipo || '_DE', count(*) FROM rel WHERE e IN (SELECT id_empresa FROM emp) AND p IN (SELECT id_cliente FROM cli UNION ALL SELECT id_empresa FROM emp) GROUP BY 1"""),
    "guarantee_adjacency": graph("SELECT src, dst FROM adj"),
    "reach_4_hops": graph("SELECT start, node, depth FROM reach"),
    "cycles_to_6": graph("SELECT length, nodes FROM cyc"),
    "circular_3": graph(f"""SELECT x.src AS a, x.dst AS b, y.dst AS c, coalesce(p.c, 0) {M} AS balance_a, coalesce(q.c, 0) {M} AS balance_b, coalesce(r.c, 0) {M} AS balance_c, coalesce(p.c, 0) {M} + coalesce(q.c, 0) {M} + coalesce(r.c, 0) {M} AS total
        FROM adj x JOIN adj y ON x.dst = y.src JOIN adj z ON y.dst = z.src AND z.dst = x.src LEFT JOIN opn p ON p.id = x.src LEFT JOIN opn q ON q.id = x.dst LEFT JOIN opn r ON r.id = y.dst WHERE x.src < x.dst AND x.src < y.dst AND x.dst <> y.dst"""),
    "guarantee_chain": graph(f"SELECT f.src AS a, f.dst AS b, s.dst AS c, f.id_prestamo AS loan_1, s.id_prestamo AS loan_2, s.c {M} AS balance, CAST(s.mora AS INTEGER) AS dias_mora FROM hops f JOIN hops s ON f.dst = s.src AND f.edge_id <> s.edge_id WHERE s.estatus = 'VENCIDO'"),
    "guarantors_of_debtors": graph("SELECT node AS debtor, start AS guarantor, depth FROM reach"),
    "shared_controllers": graph("SELECT p AS source, array_to_string(list_sort(list(e)), ',') AS companies FROM (SELECT DISTINCT p, e FROM rel WHERE tipo = 'ACCIONISTA') GROUP BY 1 HAVING count(*) >= 2"),
    "shareholder_hubs": graph("SELECT e AS target, array_to_string(list_sort(list(p)), ',') AS shareholders FROM (SELECT DISTINCT p, e FROM rel WHERE tipo = 'ACCIONISTA') GROUP BY 1 HAVING count(*) >= 3"),
    "contagion_hub": graph(f"""SELECT e AS id_empresa, count(DISTINCT p) AS persons, CAST(coalesce(sum(n), 0) AS BIGINT) AS personal_loans, coalesce(sum(opn.c), 0) {M} AS personal_exposure, coalesce(any_value(b.n2), 0) AS guaranteed_loans, coalesce(any_value(b.c2), 0) {M} AS guaranteed_exposure
        FROM accs LEFT JOIN opn ON p = id LEFT JOIN (SELECT e2, count(*) AS n2, sum(c) AS c2 FROM (SELECT DISTINCT e AS e2, pre.id_prestamo, c FROM accs JOIN gar ON p = id_garante JOIN pre USING (id_prestamo) WHERE {OPEN}) GROUP BY 1) b ON e = b.e2 GROUP BY 1"""),
    "company_loans": graph(f"SELECT id_empresa, razon_social, id_prestamo, estatus, c {M} AS saldo_vigente_mxn FROM pre JOIN emp ON id_titular = id_empresa"),
    "hub_exposure": graph(f"""WITH h AS (SELECT e FROM (SELECT DISTINCT p, e FROM rel WHERE tipo = 'ACCIONISTA') GROUP BY 1 HAVING count(*) >= 3)
        SELECT e AS id_empresa, count(DISTINCT id) AS borrowers, CAST(sum(n) AS BIGINT) AS loans, sum(c) {M} AS exposure FROM (SELECT DISTINCT e, p AS id FROM rel JOIN h USING (e) WHERE tipo = 'ACCIONISTA' UNION SELECT e, e FROM h) JOIN opn USING (id) GROUP BY 1"""),
    "controller_holdings": graph(f"SELECT p AS id_individuo, e AS id_empresa, tipo AS tipo_relacion, share AS porcentaje_participacion, id_prestamo, c {M} AS saldo_vigente_mxn FROM rel JOIN pre ON e = id_titular WHERE tipo IN ('ACCIONISTA', 'DIRECTOR') AND {OPEN}"),
    "person_exposure": graph(f"SELECT id_cliente, nombre_completo, coalesce(n, 0) AS loans, coalesce(c, 0) {M} AS exposure FROM cli LEFT JOIN opn ON id_cliente = id"),
    "concentration_risk": graph(f"""SELECT f.p AS id_cliente, companies, CAST(f.n AS BIGINT) AS corporate_loans, f.c {M} AS corporate_exposure, coalesce(o.c, 0) {M} AS personal_exposure, (f.c + coalesce(o.c, 0)) {M} AS true_concentration
        FROM (SELECT p, count(*) AS companies, coalesce(sum(n), 0) AS n, coalesce(sum(c), 0) AS c FROM accs LEFT JOIN opn ON e = id GROUP BY 1 HAVING count(*) >= 2) f LEFT JOIN opn o ON f.p = o.id"""),
    "shared_director_loans": graph(f"""SELECT p AS director, e AS id_empresa, id_prestamo, estatus, c {M} AS saldo_vigente_mxn FROM (SELECT DISTINCT p, e FROM rel WHERE tipo = 'DIRECTOR') JOIN pre ON e = id_titular
        WHERE p IN (SELECT p FROM (SELECT DISTINCT p, e FROM rel WHERE tipo = 'DIRECTOR') GROUP BY 1 HAVING count(*) >= 2)"""),
    "guaranteed_exposure": graph(f"SELECT sum(c) {M} AS per_edge, count(DISTINCT src) AS guarantors, (SELECT sum(c) {M} FROM (SELECT DISTINCT id_prestamo, c FROM hops)) AS distinct_loan, count(DISTINCT id_prestamo) AS loans FROM hops"),
    "contagion_by_guarantor": graph(f"SELECT id_garante, array_to_string(list_sort(list(id_prestamo)), ',') AS loans, sum(c) {M} AS defaulted, count(*) AS n FROM (SELECT DISTINCT id_garante, pre.id_prestamo, c FROM gar JOIN pre USING (id_prestamo) WHERE activa AND estatus = 'VENCIDO' AND mora > 90) GROUP BY 1"),
    "weighted_exposure": graph("SELECT id_garante, sum(c * pct) / CAST(10000 AS DOUBLE) AS weighted_exposure, count(*) AS guarantees FROM gar JOIN pre USING (id_prestamo) WHERE activa GROUP BY 1"),
    "related_parties": graph("SELECT x.e AS id_empresa, x.p AS a, y.p AS b FROM accs x JOIN accs y ON x.e = y.e AND x.p < y.p"),
    "risk_profile": graph(f"SELECT id_cliente, nombre_completo, estado_residencia FROM cli WHERE id_cliente IN (SELECT id_titular FROM pre WHERE {OPEN} AND pd > CAST(0.5 AS DOUBLE)) AND id_cliente IN (SELECT id_garante FROM gar WHERE activa)"),
    "default_impact": graph(f"SELECT node AS person, count(DISTINCT start) AS affected, coalesce(any_value(x.c), 0) {M} AS exposure, coalesce(sum(y.c), 0) {M} AS affected_exposure FROM reach LEFT JOIN opn x ON node = x.id LEFT JOIN opn y ON start = y.id GROUP BY 1"),
    "connected_exposure": graph(f"SELECT e AS id_empresa, count(*) AS persons, CAST(coalesce(sum(n), 0) AS BIGINT) AS loans, coalesce(sum(opn.c), 0) {M} AS exposure FROM accs LEFT JOIN opn ON p = id GROUP BY 1"),
    "guarantor_figures": graph(f"""WITH lr AS (WITH RECURSIVE t(loan, node, depth) AS (SELECT DISTINCT id_prestamo, src, 1 FROM hops UNION SELECT loan, adj.src, depth + 1 FROM t JOIN adj ON t.node = adj.dst WHERE depth < 4)
        SELECT loan, node, min(depth) AS depth FROM t GROUP BY 1, 2) SELECT id_titular AS debtor, node AS guarantor, depth, id_prestamo, c {M} AS balance, pd FROM lr JOIN pre ON loan = id_prestamo WHERE node <> id_titular"""),
    "cycle_routes": graph("""WITH nm AS (SELECT id_cliente AS id, nullif(trim(nombre_completo), '') AS name FROM cli UNION ALL SELECT id_empresa, nullif(trim(razon_social), '') FROM emp)
        SELECT length, nodes, string_agg(coalesce(name, id), ' > ' ORDER BY pos) AS route FROM (SELECT length, nodes, unnest(string_split(nodes, ',')) AS id, generate_subscripts(string_split(nodes, ','), 1) AS pos FROM cyc) LEFT JOIN nm USING (id) GROUP BY 1, 2"""),
    "client_states": graph("SELECT DISTINCT estado_residencia FROM cli"),
    "verify_scores": graph("SELECT id_prestamo, pd AS probabilidad_incumplimiento, 'v1' AS score_version, (SELECT count(*) FROM pre) AS scored FROM pre ORDER BY pd DESC, id_prestamo LIMIT 10"),
    "director_controllers": graph("SELECT p AS fullname, '' AS birthdate, count(*) AS company_count FROM accs WHERE p IN (SELECT p FROM rel WHERE tipo = 'DIRECTOR') GROUP BY 1 HAVING count(*) >= 2"),
    "companies_appended": graph("SELECT id_empresa, razon_social FROM emp UNION ALL SELECT 'EMP-' || lpad(CAST((SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY n_name, n_nationkey) AS VARCHAR), 7, '0'), n_name FROM nation"),
    "held_out_counts": f"""WITH {LABELLED}, r AS (SELECT seed, g, row_number() OVER (PARTITION BY seed ORDER BY md5(CAST(seed AS VARCHAR) || '-' || CAST(g AS VARCHAR)), g) AS rn, count(*) OVER (PARTITION BY seed) AS n
        FROM (SELECT DISTINCT g FROM l), (SELECT unnest([0, 1, 2, 3, 4]) AS seed)) SELECT seed, sum(y) AS positives, count(*) AS borrowers FROM r JOIN l USING (g) WHERE rn > floor(n * 0.8) GROUP BY 1""",
    "correlated_entities": graph("""WITH s AS (SELECT DISTINCT e, p FROM rel WHERE tipo = 'ACCIONISTA') SELECT DISTINCT * FROM (SELECT e AS id_empresa, 'company' AS role, e AS entity FROM s UNION ALL SELECT e, 'shareholder', p FROM s
        UNION ALL SELECT e, 'loan', id_prestamo FROM (SELECT e, p AS id FROM s UNION SELECT e, e FROM s) JOIN pre ON id = id_titular UNION ALL SELECT x.e, 'guarantee', edge_id FROM s x JOIN hops ON x.p = src JOIN s y ON y.e = x.e AND y.p = dst)"""),
    "portfolio_gap": graph(f"""SELECT 'loans' AS metric, CAST(count(*) AS DOUBLE) AS value FROM pre UNION ALL SELECT 'balance', sum(c) {M} FROM pre UNION ALL SELECT 'npl_percent', round(CAST(100 AS DOUBLE) * count(*) FILTER (estatus = 'VENCIDO') / count(*), 6) FROM pre
        UNION ALL SELECT 'guaranteed_distinct_loan', sum(c) {M} FROM (SELECT DISTINCT id_prestamo, c FROM hops) UNION ALL SELECT 'guaranteed_per_edge', sum(c) {M} FROM hops
        UNION ALL SELECT 'unsecured_active', sum(c) {M} FROM pre WHERE estatus = 'ACTIVO' AND NOT EXISTS (SELECT 1 FROM gar WHERE gar.id_prestamo = pre.id_prestamo)
        UNION ALL SELECT 'circular_3', count(*) FROM adj x JOIN adj y ON x.dst = y.src JOIN adj z ON y.dst = z.src AND z.dst = x.src WHERE x.src < x.dst AND x.src < y.dst AND x.dst <> y.dst
        UNION ALL SELECT 'multi_company_controllers', count(*) FROM (SELECT p FROM accs GROUP BY 1 HAVING count(*) >= 2)"""),
    "ownership_components": graph("""SELECT component, count(*) AS size, count(*) FILTER (starts_with(id, 'CLI-')) AS persons, count(*) FILTER (starts_with(id, 'EMP-')) AS companies FROM (
        WITH RECURSIVE b AS (SELECT p AS u, e AS v FROM accs UNION SELECT e, p FROM accs), t(id, o) AS (SELECT u, u FROM b UNION SELECT t.id, b.v FROM t JOIN b ON t.o = b.u) SELECT id, min(o) AS component FROM t GROUP BY 1) GROUP BY 1"""),
    "largest_components": graph("""SELECT component, count(*) AS size, count(*) FILTER (starts_with(id, 'CLI-')) AS persons, count(*) FILTER (starts_with(id, 'EMP-')) AS companies FROM (
        WITH RECURSIVE b AS (SELECT p AS u, e AS v FROM accs UNION SELECT e, p FROM accs), t(id, o) AS (SELECT u, u FROM b UNION SELECT t.id, b.v FROM t JOIN b ON t.o = b.u) SELECT id, min(o) AS component FROM t GROUP BY 1) GROUP BY 1 ORDER BY size DESC, component LIMIT 10"""),
    "degree_histogram": graph("SELECT CASE WHEN d = 1 THEN '1' WHEN d = 2 THEN '2' WHEN d <= 5 THEN '3-5' ELSE '6+' END AS bucket, count(*) AS n FROM (SELECT p, count(*) AS d FROM accs GROUP BY 1) GROUP BY 1"),
    "multi_company_controllers": graph("SELECT p AS fullname, '' AS birthdate, count(*) AS company_count FROM accs GROUP BY 1 HAVING count(*) >= 2"),
    "corporate_groups": graph("SELECT e AS parent_lei, count(*) AS children, count(razon_social) AS named FROM (SELECT DISTINCT p, e FROM rel WHERE tipo = 'SUBSIDIARIA') JOIN (SELECT id_empresa FROM emp WHERE true) q ON q.id_empresa = e LEFT JOIN emp k ON k.id_empresa = p GROUP BY 1 HAVING count(razon_social) >= 3"),
    "loan_feature_balance": graph("""SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 6) AS rate FROM (SELECT CASE WHEN estatus = 'VENCIDO' THEN 1 ELSE 0 END AS label FROM pre JOIN cli ON id_titular = id_cliente WHERE tipo_titular = 'INDIVIDUAL' AND monto IS NOT NULL AND nivel_ingresos IS NOT NULL)"""),
    "graph_features": """WITH n AS (SELECT o_custkey AS k, count(*) AS loans FROM orders WHERE o_orderkey % 211 <> 4 AND o_orderkey % 10 < 7 GROUP BY 1), b AS (SELECT c_custkey AS k, CAST(round(c_acctbal * 100) AS BIGINT) AS c,
        (0.85 * coalesce(loans, 0) / CAST(10 AS DOUBLE) - 0.65 * c_acctbal / CAST(5000 AS DOUBLE) - 0.45 * (c_custkey % 7) / CAST(7 AS DOUBLE)) / sqrt(0.85 * 0.85 + 0.65 * 0.65 + 0.45 * 0.45) AS s FROM customer LEFT JOIN n ON c_custkey = n.k),
        e AS (SELECT k AS src, 10 * (k // 10) + (k % 10 + 1) % 10 AS dst FROM b UNION SELECT k, 10 * (k // 10) + (k % 10 + 2 + k % 7) % 10 FROM b WHERE k % 3 = 0)
        SELECT b.k AS borrower_id, count(d.k) AS relationship_count, coalesce(sum(d.c), 0) / CAST(100 AS DOUBLE) AS guaranteed_exposure, round(avg(d.s), 6) AS connected_financial_stress FROM b LEFT JOIN e ON b.k = e.src LEFT JOIN b d ON e.dst = d.k GROUP BY 1""",
    "split_counts": f"""WITH {LABELLED}, {SPLIT}
        SELECT split, count(*) AS borrowers, count(DISTINCT g) AS groups, sum(y) AS positives, min(y) < max(y) AS both_classes FROM s JOIN l USING (g) GROUP BY 1""",
    "class_balance": f"""WITH {LABELLED}, {SPLIT}
        SELECT split, count(*) AS n, sum(y) AS positives, round(avg(y), 6) AS rate FROM s JOIN l USING (g) GROUP BY 1""",
    "class_weight": f"""WITH {LABELLED} SELECT CASE WHEN avg(y) > 0 THEN round((1 - avg(y)) / avg(y), 6) ELSE 1.0 END AS weight FROM l""",
    "score_metrics": """WITH p AS (SELECT (c_custkey * 7919) % 97 / CAST(97 AS DOUBLE) AS s, CASE WHEN (c_custkey * 31) % 11 < 3 THEN 1 ELSE 0 END AS y FROM customer), b AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM p GROUP BY 1),
        c AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp FROM b)
        SELECT round(sum(neg * (tp - pos / CAST(2 AS DOUBLE))) / (sum(pos) * sum(neg)), 6) AS roc_auc, round(sum(pos * (tp / CAST(tp + fp AS DOUBLE))) / sum(pos), 6) AS average_precision, (SELECT round(avg((s - y) * (s - y)), 6) FROM p) AS brier,
        (SELECT round(avg(-(y * ln(least(greatest(s, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(s, 1e-15), 1 - 1e-15)))), 6) FROM p) AS log_loss FROM c""",
    "repeated_curps": graph("SELECT curp, count(*) AS n FROM cli GROUP BY 1 HAVING count(*) > 1"),
    "ingest_report": etl("SELECT entity_type, count(*) AS raw, count(*) FILTER (len(r) = 0) AS clean, count(*) FILTER (len(r) > 0) AS rejected, 'PASS' AS status, CAST(sum(len(r)) AS BIGINT) AS rule_hits FROM allrows GROUP BY 1"),
    "concentration_all": graph(f"""SELECT f.p AS id_cliente, companies, CAST(f.n AS BIGINT) AS corporate_loans, f.c {M} AS corporate_exposure, coalesce(o.c, 0) {M} AS personal_exposure, (f.c + coalesce(o.c, 0)) {M} AS true_concentration
        FROM (SELECT p, count(*) AS companies, coalesce(sum(n), 0) AS n, coalesce(sum(c), 0) AS c FROM accs LEFT JOIN opn ON e = id GROUP BY 1) f LEFT JOIN opn o ON f.p = o.id"""),
    "hub_edges": graph("""WITH parties AS (SELECT id_cliente AS id FROM cli UNION SELECT id_empresa FROM emp), ed AS (SELECT 'TIENE_PRESTAMO' AS edge_type, id_titular AS src, id_prestamo AS dst FROM pre WHERE id_titular IN (SELECT id FROM parties)
        UNION ALL SELECT 'GARANTIZA', id_garante, id_prestamo FROM gar WHERE id_garante IN (SELECT id FROM parties) AND id_prestamo IN (SELECT id_prestamo FROM pre)
        UNION ALL SELECT 'ES_' || tipo || '_DE', p, e FROM rel WHERE e IN (SELECT id_empresa FROM emp) AND p IN (SELECT id FROM parties)),
        h AS (SELECT e AS node FROM (SELECT DISTINCT p, e FROM rel WHERE tipo = 'ACCIONISTA') GROUP BY 1 HAVING count(*) >= 3)
        SELECT node, 'out' AS direction, edge_type, dst AS other FROM ed JOIN h ON src = node UNION ALL SELECT node, 'in', edge_type, src FROM ed JOIN h ON dst = node"""),
    "party_counts": graph("SELECT e AS id_empresa, count(*) AS members, count(*) * (count(*) - 1) // 2 AS pairs FROM accs GROUP BY 1"),
    "loans_from_csv": graph(f"SELECT id_prestamo, id_titular, estatus, monto AS monto_original_mxn, c {M} AS saldo_vigente_mxn, CAST(mora AS INTEGER) AS dias_mora FROM pre"),
    "clean_from_store": etl("SELECT entity_type, count(*) FILTER (len(r) = 0) AS n FROM allrows GROUP BY 1"),
    "rejects_from_store": etl("SELECT id, entity_type, array_to_string(r, ' | ') AS rejection_reasons FROM allrows WHERE len(r) > 0"),
    "registry_companies": graph("SELECT id_empresa AS lei, coalesce(razon_social, '') AS legal_name, 'MX-' || estado AS address_region FROM emp WHERE num_empleados IS NOT NULL"),
    "split_membership": f"""WITH {LABELLED}, r AS (SELECT seed, g, row_number() OVER (PARTITION BY seed ORDER BY md5(CAST(seed AS VARCHAR) || '-' || CAST(g AS VARCHAR)), g) AS rn, count(*) OVER (PARTITION BY seed) AS n
        FROM (SELECT DISTINCT g FROM l), (SELECT unnest([0, 1]) AS seed)) SELECT seed, c_custkey AS borrower_id, g AS group_id, CASE WHEN rn <= floor(n * 0.6) THEN 'train' WHEN rn <= floor(n * 0.8) THEN 'calibration' ELSE 'test' END AS split
        FROM r JOIN customer ON c_custkey // 10 = g""",
    "score_history": graph("""SELECT score_version, count(*) AS n, round(avg(pd), 6) AS mean, round(stddev(pd), 6) AS stddev, min(pd) AS min, median(pd) AS median, max(pd) AS max
        FROM (SELECT 'v1' AS score_version, pd FROM pre UNION ALL SELECT 'v2', pd / 2 FROM pre WHERE estatus <> 'PAGADO') GROUP BY 1"""),
    "not_rescored": graph("SELECT id_prestamo FROM pre WHERE estatus = 'PAGADO'"),
    "strong_components": graph(f"WITH {EVER} SELECT node, component FROM scc"),
    "reach_counts": graph(f"WITH {EVER} SELECT scc.node, component, size, (SELECT count(*) FROM ever WHERE ever.start = scc.node) AS reached FROM scc"),
    "reach_unlimited": graph("""WITH far AS (WITH RECURSIVE t(start, node, depth) USING KEY (start, node) AS (SELECT DISTINCT src, src, 0 FROM adj
        UNION SELECT DISTINCT t.start, adj.dst, t.depth + 1 FROM t JOIN adj ON t.node = adj.src LEFT JOIN recurring.t AS r ON r.start = t.start AND r.node = adj.dst WHERE r.node IS NULL) SELECT * FROM t) SELECT start, node, depth FROM far WHERE start <> node"""),
    "reach_from_hubs": graph("""WITH h AS (SELECT src FROM adj GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 10), far AS (WITH RECURSIVE t(start, node, depth) AS (SELECT src, src, 0 FROM h UNION SELECT start, adj.dst, depth + 1 FROM t JOIN adj ON t.node = adj.src WHERE depth < 300)
        SELECT start, node, min(depth) AS depth FROM t WHERE start <> node GROUP BY 1, 2) SELECT start, node, depth FROM far"""),
    "cycles_unbounded": graph("""WITH whole AS (SELECT DISTINCT id_garante AS src, id_titular AS dst FROM gar JOIN pre USING (id_prestamo) WHERE pct = 100), ring AS (WITH RECURSIVE t(root, node, nodes) AS (SELECT src, dst, [src, dst] FROM whole WHERE dst > src
        UNION ALL SELECT root, whole.dst, list_append(nodes, whole.dst) FROM t JOIN whole ON t.node = whole.src WHERE whole.dst > root AND NOT list_contains(nodes, whole.dst))
        SELECT len(nodes) AS length, array_to_string(nodes, ',') AS nodes FROM t JOIN whole ON whole.src = t.node AND whole.dst = t.root) SELECT length, nodes FROM ring"""),
    "subgraph_stats": graph("""WITH b AS (SELECT p AS u, e AS v FROM accs UNION SELECT e, p FROM accs), cc AS (WITH RECURSIVE t(id, o) AS (SELECT u, u FROM b UNION SELECT t.id, b.v FROM t JOIN b ON t.o = b.u) SELECT id, min(o) AS component FROM t GROUP BY 1),
        sz AS (SELECT count(*) AS n FROM cc GROUP BY component), pp AS (SELECT count(*) AS n FROM accs GROUP BY p), pf AS (SELECT count(*) AS n FROM accs GROUP BY e)
        SELECT (SELECT count(DISTINCT p) FROM accs) AS persons, (SELECT count(DISTINCT e) FROM accs) AS companies, (SELECT count(*) FROM accs) AS edges, (SELECT count(*) FROM sz) AS components, (SELECT max(n) FROM sz) AS largest_component,
        (SELECT count(*) FROM pp WHERE n > 1) AS multi_company_persons, (SELECT round(sum(n) / CAST(count(*) AS DOUBLE), 2) FROM pp) AS mean_companies, (SELECT max(n) FROM pp) AS max_companies,
        (SELECT count(*) FROM pf WHERE n > 1) AS shared_companies, (SELECT round(sum(n) / CAST(count(*) AS DOUBLE), 2) FROM pf) AS mean_controllers"""),
    "experiment_split_counts": f"""WITH {LABELLED}, r AS (SELECT seed, g, row_number() OVER (PARTITION BY seed ORDER BY md5(CAST(seed AS VARCHAR) || '-' || CAST(g AS VARCHAR)), g) AS rn, count(*) OVER (PARTITION BY seed) AS n
        FROM (SELECT DISTINCT g FROM l), (SELECT unnest([1, 3]) AS seed)), s AS (SELECT seed, g, CASE WHEN rn <= floor(n * 0.6) THEN 'train' WHEN rn <= floor(n * 0.8) THEN 'calibration' ELSE 'test' END AS split FROM r)
        SELECT condition, seed, split, count(*) AS borrowers, count(DISTINCT g) AS groups, sum(y) AS positives, min(y) < max(y) AS both_classes FROM s JOIN l USING (g), (SELECT unnest(['all_edges', 'ring_edges']) AS condition) GROUP BY 1, 2, 3""",
    "calibration_curve": f"""WITH {SCORED}, e AS (SELECT quantile_cont(s, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM p)
        SELECT 'fixed' AS model, CAST(len(list_filter(e, lambda x: x < s)) AS INTEGER) AS bin, count(*) AS n, round(avg(s), 6) AS mean_score, round(avg(y), 6) AS event_rate FROM p, e GROUP BY 2""",
    "classification_report": f"""WITH {SCORED}, h AS (SELECT y, CASE WHEN s >= 0.5 THEN 1 ELSE 0 END AS h FROM p), k AS (SELECT c AS class, count(*) FILTER (y = c AND h = c) AS tp, count(*) FILTER (y <> c AND h = c) AS fp, count(*) FILTER (y = c AND h <> c) AS fn
        FROM h, (SELECT unnest([0, 1]) AS c) GROUP BY 1), q AS (SELECT *, tp / CAST(tp + fp AS DOUBLE) AS pr, tp / CAST(tp + fn AS DOUBLE) AS re FROM k)
        SELECT class, tp, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / (pr + re), 6) AS f1, tp + fn AS support FROM q""",
    "bootstrap_intervals": f"""WITH {SCORED}, gr AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, max(y) AS pos, max(1 - y) AS neg FROM p GROUP BY 1),
        d AS (SELECT attempt, CAST(floor(CAST(('0x' || substr(md5('0-' || attempt || '-' || j), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) * n) AS BIGINT) AS i FROM range(1000) a(attempt), (SELECT max(n) AS n FROM gr), range((SELECT max(n) FROM gr)) b(j)),
        w AS (SELECT attempt, g, count(*) AS w, max(max(pos)) OVER (PARTITION BY attempt) + max(max(neg)) OVER (PARTITION BY attempt) AS two FROM d JOIN gr USING (i) GROUP BY 1, 2),
        k AS (SELECT attempt, g, w FROM w WHERE two = 2 AND attempt IN (SELECT DISTINCT attempt FROM w WHERE two = 2 ORDER BY 1 LIMIT 50)),
        sc AS (SELECT attempt, s, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM k JOIN p USING (g) GROUP BY 1, 2),
        c AS (SELECT *, sum(pos) OVER (PARTITION BY attempt ORDER BY s DESC) AS tp, sum(pos + neg) OVER (PARTITION BY attempt ORDER BY s DESC) AS n FROM sc),
        m AS (SELECT attempt, round(sum(neg * (tp - pos / CAST(2 AS DOUBLE))) / (sum(pos) * sum(neg)), 6) AS roc_auc, round(sum(pos * tp / CAST(n AS DOUBLE)) / sum(pos), 6) AS average_precision,
        round(sum(pos * (1 - s) ** 2 + neg * s ** 2) / sum(pos + neg), 6) AS brier, round(sum(-pos * ln(greatest(s, 1e-15)) - neg * ln(1 - greatest(s, 1e-15))) / sum(pos + neg), 6) AS log_loss FROM c GROUP BY 1),
        v AS (UNPIVOT m ON roc_auc, average_precision, brier, log_loss INTO NAME metric VALUE value)
        SELECT 'fixed' AS model, metric, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM v GROUP BY 2""",
}
ORACLES |= {f"{name}_stored": ORACLES[name] for name in ("guarantee_chain", "guarantee_adjacency")}
