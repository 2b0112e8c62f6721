"""Checks of scenario documents: tables nodes, edges, loans and metrics, each with a scenario column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculo.operators.exposure import exposure_metrics
from vinculo.operators.graph import cycles, reachable, shared_controllers, shareholder_hubs


def scenario_adjacency(edges: DataFrame, loans: DataFrame) -> DataFrame:
    """(scenario, src, dst): guarantor to the owner of the guaranteed loan."""
    g = edges.where("type = 'guarantees'").select("scenario", F.col("source").alias("src"), F.col("target").alias("loan"))
    owner = edges.where("type = 'owns'").select("scenario", F.col("source").alias("dst"), F.col("target").alias("loan"))
    listed = loans.select("scenario", F.col("borrower_id").alias("dst"), F.col("id").alias("loan"))
    return g.join(owner.unionByName(listed).distinct(), ["scenario", "loan"]).select("scenario", "src", "dst").distinct()


def validate_document(nodes: DataFrame, edges: DataFrame, loans: DataFrame, metrics: DataFrame) -> DataFrame:
    """(scenario, violation, detail); empty for a valid document."""
    ids = nodes.select("scenario", "id").unionByName(loans.select("scenario", "id")).distinct()
    row = lambda df, what, detail: df.select("scenario", F.lit(what).alias("violation"), detail.cast("string").alias("detail"))
    ends = edges.select("scenario", F.col("source").alias("id")).unionByName(edges.select("scenario", F.col("target").alias("id"))).distinct()
    again = exposure_metrics(loans, ["scenario"])
    both = metrics.toDF(*["scenario" if c == "scenario" else f"stored_{c}" for c in metrics.columns]).join(again, "scenario", "full")
    same = reduce(lambda a, b: a & b, [F.col(f"stored_{c}").eqNullSafe(F.col(c)) for c in ("exposure_mxn", "loans", "borrowers")])
    owned = edges.where("type = 'owns'").groupBy("scenario", F.col("target").alias("id")).agg(F.countDistinct("source").alias("owners"))
    return reduce(DataFrame.unionByName, [
        row(nodes.groupBy("scenario", "id").count().where("count > 1"), "duplicate node", F.col("id")),
        row(ends.join(ids, ["scenario", "id"], "left_anti"), "dangling edge end", F.col("id")),
        row(loans.groupBy("scenario", "id").count().where("count > 1"), "duplicate loan", F.col("id")),
        row(loans.select("scenario", "id").distinct().join(owned, ["scenario", "id"], "left").where("coalesce(owners, 0) <> 1"), "loan not owned once", F.col("id")),
        row(again.where("conflicts > 0"), "conflicting balances", F.col("conflicts")),
        row(both.where(~same), "metrics differ", F.col("exposure_mxn"))])


def validate_patterns(edges: DataFrame, loans: DataFrame, chain: tuple[str, ...] = ("P11", "P12", "P13")) -> DataFrame:
    """(scenario, pattern, holds): the patterns that the four scenarios are meant to show; the first of ``chain`` reaches the others."""
    adj = scenario_adjacency(edges, loans)
    spark = edges.sparkSession

    def of(name: str) -> DataFrame:
        return adj.where(F.col("scenario") == name).select("src", "dst")

    part = lambda name, kind: edges.where((F.col("scenario") == name) & (F.col("type") == kind)).select("source", "target")
    start = spark.createDataFrame([(chain[0],)], "start string")
    reach = reachable(of("chain"), start).agg(F.array_join(F.array_sort(F.collect_set("node")), ",").alias("x"))
    count = lambda df: df.agg(F.count("*").alias("x"))
    row = lambda df, s, p, holds: df.select(F.lit(s).alias("scenario"), F.lit(p).alias("pattern"), holds.alias("holds"))
    return reduce(DataFrame.unionByName, [
        row(count(shared_controllers(part("control", "controls"))), "control", "shared controller", F.col("x") > 0),
        row(reach, "chain", f"reach of {chain[0]}", F.col("x") == ",".join(sorted(chain[1:]))),
        row(count(cycles(of("chain"))), "chain", "no cycle", F.col("x") == 0),
        row(count(cycles(of("cycle"))), "cycle", "one cycle", F.col("x") == 1),
        row(count(shareholder_hubs(part("hub", "shareholder"))), "hub", "hub company", F.col("x") > 0),
        row(count(cycles(of("hub"))), "hub", "cross guarantee", F.col("x") > 0)])
