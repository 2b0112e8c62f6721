"""Fixed schemas of the portfolio's tables and of the landed registry files."""

from __future__ import annotations

from pyspark.sql.types import StructType, _parse_datatype_string

# Column names and types of the raw tables; dates and flags are text until a rule parses them.
RAW_DDL = {
    "clientes": "id_cliente string, nombre_completo string, curp string, fecha_nacimiento string, estado_residencia string, nivel_ingresos double, antiguedad_cliente_meses int, score_buro double, historico_incumplimientos int, fecha_ultimo_incumplimiento string",
    "empresas": "id_empresa string, razon_social string, rfc string, sector string, tamano string, ingresos_anuales_mxn double, anos_operacion int, num_empleados int, estado_registro string",
    "prestamos": "id_prestamo string, id_titular string, tipo_titular string, monto_original_mxn double, saldo_vigente_mxn double, tasa_interes_anual double, fecha_inicio string, fecha_vencimiento string, estatus string, dias_mora int, probabilidad_incumplimiento double, score_version string, score_fecha string",
    "garantias": "id_garantia string, id_prestamo string, id_garante string, tipo_garantia string, cobertura_porcentaje double, fecha_inicio string, fecha_vencimiento string, activa string",
    "relaciones": "id_relacion string, id_individuo string, id_empresa string, tipo_relacion string, porcentaje_participacion double, fecha_inicio string, fecha_fin string, activa string",
}
KEYS = {"clientes": "id_cliente", "empresas": "id_empresa", "prestamos": "id_prestamo", "garantias": "id_garantia", "relaciones": "id_relacion"}
LABELS = {"clientes": "CLIENTE", "empresas": "EMPRESA", "prestamos": "PRESTAMO", "garantias": "GARANTIA", "relaciones": "RELACION"}
REGISTRY_PAGE = (
    "data array<struct<attributes: struct<lei: string, entity: struct<legalName: struct<name: string>, status: string, jurisdiction: string, registeredAs: string,"
    " legalForm: struct<id: string>, creationDate: string, legalAddress: struct<city: string, region: string, country: string, postalCode: string>>,"
    " relationship: struct<startNode: struct<id: string>, endNode: struct<id: string>, type: string, status: string>, validFrom: string, validTo: string>>>"
)
SCENARIOS = (
    "scenarios array<struct<id: string, nodes: array<struct<id: string, label: string, type: string>>, edges: array<struct<source: string, target: string, type: string>>,"
    " loans: array<struct<id: string, borrower: string, borrower_id: string, amount_mxn: double>>, metrics: struct<exposure_mxn: bigint, loans: bigint, borrowers: bigint>>>"
)


def raw_schema(entity: str) -> StructType:
    return _parse_datatype_string(RAW_DDL[entity])
