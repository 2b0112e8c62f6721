"""The five raw tables, derived from the driver's star schema by fixed formulas."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculo.functions.columns import cents, size_band

SECTOR_LIST = ["COMERCIO", "SERVICIOS", "MANUFACTURA", "CONSTRUCCION", "TRANSPORTE"]


def key(prefix: str, n: Column, width: int) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.lpad(n.cast("string"), width, "0"))


def day(start: str | Column, add: Column) -> Column:
    return F.date_format(F.date_add(F.to_date(F.lit(start)) if isinstance(start, str) else start, add.cast("int")), "yyyy-MM-dd")


class Portfolio:
    """Raw tables of one directory; each is a plan, nothing is read before an action."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def customers(self) -> int:
        return self.table("customer").count()

    @cached_property
    def suppliers(self) -> int:
        return self.table("supplier").count()

    @cached_property
    def clientes(self) -> DataFrame:
        k = F.col("c_custkey")
        name = F.when(k % 37 == 5, None).when(k % 41 == 5, "N/A").when(k % 43 == 5, F.concat(F.lit("PRUEBA "), "c_name")).otherwise(F.col("c_name"))
        curp = F.when(k % 29 == 3, F.concat(F.lit("CURP"), F.lpad(k.cast("string"), 11, "0"))).when(k % 31 == 1, F.concat(F.lit("CURP"), F.lpad((k - 1).cast("string"), 14, "0"))).otherwise(F.concat(F.lit("CURP"), F.lpad(k.cast("string"), 14, "0")))
        birth = F.when(k % 97 == 6, "2027-01-01").when(k % 89 == 6, "2010-01-01").otherwise(day("1950-01-01", (k * 37) % 18000))
        state = F.when(k % 17 == 0, None).when(k % 25 == 3, "Ciudad de Mexico").when(k % 25 == 4, "CDMX").otherwise(F.col("n_name"))
        rows = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        return rows.select(
            key("CLI", k, 7).alias("id_cliente"), name.alias("nombre_completo"), curp.alias("curp"), birth.alias("fecha_nacimiento"), state.alias("estado_residencia"),
            F.when(k % 23 == 2, None).otherwise(F.col("c_acctbal")).alias("nivel_ingresos"), (k % 240 + 1).cast("int").alias("antiguedad_cliente_meses"),
            ((k * 7919) % 571 + 290).cast("double").alias("score_buro"), (k % 6).cast("int").alias("historico_incumplimientos"), F.lit(None).cast("string").alias("fecha_ultimo_incumplimiento"))

    @cached_property
    def empresas(self) -> DataFrame:
        k = F.col("s_suppkey")
        staff = F.when(k % 19 == 3, None).otherwise((k * 53) % 900 + 1).cast("int")
        revenue = F.when(k % 21 == 4, None).when(k % 21 == 5, 0.0).otherwise(F.abs("s_acctbal") * 1000)
        code = F.element_at(F.array(*map(F.lit, ["CMX", "NL", "JAL", "MEX", "QRO"])), (k % 5 + 1).cast("int"))
        rows = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
        return rows.select(
            key("EMP", k, 7).alias("id_empresa"), F.when(k % 50 == 7, None).otherwise(F.col("s_name")).alias("razon_social"),
            F.concat(F.lit("RFC"), F.lpad(k.cast("string"), 9, "0"), F.when(k % 33 == 6, "X").otherwise("")).alias("rfc"),
            F.element_at(F.array(*map(F.lit, SECTOR_LIST)), (k % 5 + 1).cast("int")).alias("sector"), size_band(staff).alias("tamano"), revenue.alias("ingresos_anuales_mxn"),
            (k % 30 + 1).cast("int").alias("anos_operacion"), staff.alias("num_empleados"), F.when(k % 4 == 0, code).otherwise(F.col("n_name")).alias("estado_registro"))

    @cached_property
    def prestamos(self) -> DataFrame:
        k, price, status = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderstatus")
        c = cents("o_totalprice")
        holder = F.when(k % 211 == 4, "CLI-9999999").when(k % 10 < 7, key("CLI", F.col("o_custkey"), 7)).otherwise(key("EMP", F.expr("o_orderkey div 10") % self.suppliers, 7))
        balance = F.when(status == "F", 0.0).when(k % 113 == 6, F.expr("(c * 12 + 5) div 10") / 100.0).otherwise(F.expr("(c * (10 + o_orderkey % 86) + 50) div 100") / 100.0)
        start = F.date_add(F.to_date("o_orderdate"), 9000)
        state = F.when(status == "O", "ACTIVO").when(status == "F", "PAGADO").when(k % 3 == 0, "VENCIDO").when(k % 3 == 1, "REESTRUCTURADO").otherwise("ACTIVO")
        late = F.when((status == "P") & (k % 3 == 0), k % 150 + 31).when((status == "P") & (k % 3 == 1), k % 31).when((status == "O") & (k % 127 == 9), 12).otherwise(0)
        return self.table("orders").withColumn("c", c).select(
            key("PRE", k, 9).alias("id_prestamo"), holder.alias("id_titular"), F.when(k % 151 == 3, "EMPRESA").when(k % 10 < 7, "INDIVIDUAL").otherwise("EMPRESA").alias("tipo_titular"),
            F.when(k % 307 == 5, None).when(k % 401 == 5, -price).otherwise(price).alias("monto_original_mxn"), balance.alias("saldo_vigente_mxn"),
            F.when(k % 223 == 7, 0.9).otherwise((k % 41 + 5) / 100.0).alias("tasa_interes_anual"), F.date_format(start, "yyyy-MM-dd").alias("fecha_inicio"),
            F.when(k % 199 == 8, day(start, F.lit(-30))).otherwise(day(start, (k % 5 + 1) * 365)).alias("fecha_vencimiento"), state.alias("estatus"), late.cast("int").alias("dias_mora"),
            ((k * 31) % 100 / 100.0).alias("probabilidad_incumplimiento"), F.lit("v1").alias("score_version"), F.lit("2026-03-15").alias("score_fecha"))

    @cached_property
    def garantias(self) -> DataFrame:
        line = self.table("lineitem").where("l_linenumber = 1 AND l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o")).agg(F.min("l_suppkey").alias("sk"), F.min("l_partkey").alias("pk"))
        o = F.col("o")
        kind = F.element_at(F.array(*map(F.lit, ["PERSONAL", "HIPOTECARIA", "PRENDARIA", "AVAL"])), (o % 4 + 1).cast("int"))
        plain = line.select(
            key("GAR", o, 9).alias("id_garantia"), F.when(o % 173 == 2, "PRE-999999999").otherwise(key("PRE", o, 9)).alias("id_prestamo"),
            F.when(o % 181 == 2, "CLI-9999999").otherwise(key("CLI", (F.col("pk") * 31 + F.col("sk") * 17 + 1) % self.customers, 7)).alias("id_garante"), kind.alias("tipo_garantia"),
            ((o % 76 + 25) / 100.0).alias("cobertura_porcentaje"), F.lit("2024-01-01").alias("fecha_inicio"), F.when(o % 61 == 1, "2026-01-01").otherwise("2027-06-30").alias("fecha_vencimiento"),
            F.when(o % 67 == 1, "False").otherwise("True").alias("activa"))
        first = self.prestamos.where(F.col("estatus").isin("ACTIVO", "REESTRUCTURADO")).groupBy("id_titular").agg(F.min("id_prestamo").alias("id_prestamo"))
        k = F.col("c_custkey")
        ring = self.table("customer").where((k % 30).between(9, 11)).select(k, key("CLI", k - k % 3 + (k + 1) % 3, 7).alias("id_titular")).join(first, "id_titular", "left")
        planted = ring.select(
            F.concat(F.lit("GAR-R"), F.lpad(k.cast("string"), 8, "0")).alias("id_garantia"), "id_prestamo", key("CLI", k, 7).alias("id_garante"), F.lit("AVAL").alias("tipo_garantia"),
            F.lit(1.0).alias("cobertura_porcentaje"), F.lit("2024-01-01").alias("fecha_inicio"), F.lit("2027-06-30").alias("fecha_vencimiento"), F.lit("True").alias("activa"))
        return plain.unionByName(planted)

    @cached_property
    def relaciones(self) -> DataFrame:
        m = max(self.suppliers * 3 // 4, 1)
        k = F.col("k")
        base = self.table("supplier").select(F.col("s_suppkey").alias("k"))

        def rows(df: DataFrame, ident: Column, person: Column, company: Column, kind: str, share: Column) -> DataFrame:
            return df.select(ident.alias("id_relacion"), person.alias("id_individuo"), company.alias("id_empresa"), F.lit(kind).alias("tipo_relacion"), share.alias("porcentaje_participacion"),
                             F.lit("2020-01-01").alias("fecha_inicio"), F.lit(None).cast("string").alias("fecha_fin"), F.lit("True").alias("activa"))

        ident = lambda letter, n, w: F.concat(F.lit(f"REL-{letter}"), F.lpad(n.cast("string"), w, "0"))
        share = (k % 50 + 10) / 100.0
        hubs = base.where("k % 10 = 1").select("k", F.explode(F.array(F.lit(1), F.lit(2))).alias("j"))
        return (
            rows(base, ident("A", k, 7), F.when(k % 83 == 9, "CLI-9999999").otherwise(key("CLI", k % m, 7)), key("EMP", k, 7), "ACCIONISTA", share)
            .unionByName(rows(base.where("k % 5 = 0"), ident("D", k, 7), key("CLI", (k + 1) % m, 7), key("EMP", k, 7), "DIRECTOR", F.lit(None).cast("double")))
            .unionByName(rows(hubs, ident("H", k * 10 + F.col("j"), 8), key("CLI", (k * 3 + 20 + F.col("j")) % self.customers, 7), key("EMP", k, 7), "ACCIONISTA", share))
            .unionByName(rows(base.where("k % 5 <> 0"), ident("S", k, 7), key("EMP", k, 7), F.when(k % 49 == 9, "EMP-9999999").otherwise(key("EMP", k - k % 5, 7)), "SUBSIDIARIA", F.lit(1.0))))
