"""The property graph of borrowers, loans and companies, and its risk patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculo.functions.columns import cents, pesos
from vinculo.functions.components import connected_components
from vinculo.functions.reach import HUBS, WEIGHT, bounded_reach, heavy_nodes, reach_pairs, reach_sums, search, unbounded_reach
from vinculo.functions.runtime import materialize
from vinculo.functions.strong import contracted, strong_components
from vinculo.operators.exposure import is_open, portfolio_overview, unsecured_active


#: Rounds of trimming before cycles are sought.
TRIMS = 3


def graph_nodes(cli: DataFrame, emp: DataFrame, pre: DataFrame) -> DataFrame:
    """(label, id, name, amount): the three kinds of nodes; empty text becomes null."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    return (
        cli.select(F.lit("ClienteIndividual").alias("label"), F.col("id_cliente").alias("id"), text("nombre_completo").alias("name"), F.col("nivel_ingresos").alias("amount"))
        .unionByName(emp.select(F.lit("Empresa").alias("label"), F.col("id_empresa").alias("id"), text("razon_social").alias("name"), F.col("ingresos_anuales_mxn").alias("amount")))
        .unionByName(pre.select(F.lit("Prestamo").alias("label"), F.col("id_prestamo").alias("id"), F.lit(None).cast("string").alias("name"), F.col("saldo_vigente_mxn").alias("amount"))))


def graph_edges(cli: DataFrame, emp: DataFrame, pre: DataFrame, gar: DataFrame, rel: DataFrame, strict_type: bool = False) -> DataFrame:
    """(edge_type, edge_id, src, dst, weight): an edge exists only if both of its nodes do."""
    people, firms, loans = cli.select(F.col("id_cliente").alias("src")), emp.select(F.col("id_empresa").alias("dst")), pre.select(F.col("id_prestamo").alias("dst"))
    parties = people.unionByName(emp.select(F.col("id_empresa").alias("src"))).distinct()
    owned = pre.where(((F.col("tipo_titular") == "INDIVIDUAL") & F.col("id_titular").startswith("CLI-")) | ((F.col("tipo_titular") == "EMPRESA") & F.col("id_titular").startswith("EMP-"))) if strict_type else pre
    shape = lambda df, kind, ident, a, b, w: df.select(kind.alias("edge_type"), F.col(ident).alias("edge_id"), F.col(a).alias("src"), F.col(b).alias("dst"), w.cast("double").alias("weight"))
    has = shape(owned, F.lit("TIENE_PRESTAMO"), "id_prestamo", "id_titular", "id_prestamo", F.col("saldo_vigente_mxn")).join(parties, "src", "left_semi")
    backs = shape(gar, F.lit("GARANTIZA"), "id_garantia", "id_garante", "id_prestamo", F.col("cobertura_porcentaje")).join(parties, "src", "left_semi").join(loans, "dst", "left_semi")
    kind = F.concat(F.lit("ES_"), "tipo_relacion", F.lit("_DE"))
    ties = shape(rel.where(F.col("tipo_relacion").isin("ACCIONISTA", "DIRECTOR", "SUBSIDIARIA")), kind, "id_relacion", "id_individuo", "id_empresa", F.col("porcentaje_participacion")).join(parties, "src", "left_semi").join(firms, "dst", "left_semi")
    return reduce(DataFrame.unionByName, [has, backs, ties])


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.groupBy(F.col("label").alias("kind")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.col("edge_type").alias("kind")).agg(F.count("*").alias("n")))


def guarantee_hops(gar: DataFrame, pre: DataFrame) -> DataFrame:
    """(edge_id, src, dst, id_prestamo): guarantor to owner of the guaranteed loan, one row per guarantee."""
    loans = pre.select("id_prestamo", F.col("id_titular").alias("dst"))
    return gar.where("id_garante is not null").select(F.col("id_garantia").alias("edge_id"), F.col("id_garante").alias("src"), "id_prestamo").join(loans.where("dst is not null"), "id_prestamo").select("edge_id", "src", "dst", "id_prestamo")


def guarantee_adjacency(gar: DataFrame, pre: DataFrame) -> DataFrame:
    """Distinct (src, dst); guarantees of unknown loans are dropped."""
    return guarantee_hops(gar, pre).select("src", "dst").distinct()


def reachable(adj: DataFrame, starts: DataFrame | None = None, max_hops: int | None = None) -> DataFrame:
    """(start, node, depth): nodes within ``max_hops`` of each start, the start left out, with least depth.

    With a bound pairs over hubs come from the hubs' own distances; without one starts travel as bits.
    """
    return unbounded_reach(adj, starts) if max_hops is None else reach_pairs(bounded_reach(adj, starts, max_hops))


def _segments(adj: DataFrame) -> DataFrame:
    """(src, dst, inner): the edges of ``adj`` with runs of nodes without a choice as one edge, whose nodes are ``inner``."""
    short, inner = contracted(adj)
    nodes = inner.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("place", "node")))["node"].alias("inner"))
    return short.join(nodes, "head", "left").select("src", "dst", F.coalesce("inner", F.array().cast("array<string>")).alias("inner"))


def _cycles_at(adj: DataFrame, hub: DataFrame, max_len: int) -> DataFrame:
    """(nodes): the simple cycles of 2 to ``max_len`` nodes through the one node of ``hub(start)``, from it, over distinct edges.

    A path goes on only to nodes from which the way back still fits, so what is written grows with the cycles.
    """
    back = search(adj.select(F.col("dst").alias("src"), F.col("src").alias("dst")), hub, max_len - 1).select(F.col("node").alias("dst"), F.col("depth").alias("togo"))
    home = hub.select(F.col("start").alias("dst"), F.lit(0).alias("togo"))
    step = materialize(adj.join(back.unionByName(home), "dst").select(F.col("src").alias("last"), "dst", "togo"))
    paths, found = hub.select(F.col("start").alias("last"), F.array("start").alias("nodes")), []
    for _ in range(max_len):
        grown = paths.join(step, "last").where((F.size("nodes") + F.col("togo") <= max_len) & ((F.col("togo") == 0) | ~F.array_contains("nodes", F.col("dst"))))
        grown = materialize(grown.select(F.col("dst").alias("last"), F.when(F.col("togo") == 0, F.col("nodes")).otherwise(F.array_append("nodes", F.col("dst"))).alias("nodes"), (F.col("togo") == 0).alias("shut")))
        found.append(grown.where("shut").select("nodes"))
        paths = grown.where("not shut").drop("shut")
        if paths.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def cycles(adj: DataFrame, max_len: int | None = None, most: int = HUBS, weight: int = WEIGHT) -> DataFrame:
    """(length, nodes): directed simple cycles of 2 or more nodes, at most ``max_len`` if given, each once, from its smallest node.

    Without a bound only edges inside a strongly connected component are followed, and runs of nodes without a choice are one
    step, so a ring of any size is found at once and paths grow by branching nodes alone. With a bound nodes that no cycle
    can hold are trimmed, in TRIMS rounds, and cycles through a hub (``reach.heavy_nodes``) are sought from it before it is taken
    out, as the paths over it are as many as its edges in times its edges out. Paths grow only to nodes above their root, which gives each cycle one rotation.
    The number of cycles can itself grow exponentially with a dense component; bound the length there. Ids are text.
    """
    adj, at_hubs = materialize(adj.where("src <> dst").select("src", "dst").distinct()), []
    if max_len is None:
        member = strong_components(adj)
        a, b = member.toDF("src", "c"), member.toDF("dst", "d")
        steps = materialize(_segments(materialize(adj.join(a, "src").join(b, "dst").where("c = d").select("src", "dst"))))
    else:
        for _ in range(TRIMS):  # written each time: a plan that reads itself twice a round would double with each
            both = adj.select(F.col("src").alias("n")).distinct().join(adj.select(F.col("dst").alias("n")).distinct(), "n", "left_semi")
            adj = materialize(adj.join(both.select(F.col("n").alias("src")), "src", "left_semi").join(both.select(F.col("n").alias("dst")), "dst", "left_semi").select("src", "dst"))
        hubs = heavy_nodes(adj, most, weight)
        for h in hubs:
            at_hubs.append(_cycles_at(adj, adj.sparkSession.createDataFrame([(h,)], adj.select(F.col("src").alias("start")).schema), max_len))
            adj = materialize(adj.where((F.col("src") != h) & (F.col("dst") != h)))
        steps = adj.select("src", "dst", F.array().cast("array<string>").alias("inner"))
    found = steps.where("src = dst").select(F.concat(F.array("src"), "inner").alias("nodes"))
    step = steps.select(F.col("src").alias("last"), "dst", "inner")
    paths = steps.where("dst > src").select(F.col("src").alias("root"), F.col("dst").alias("last"), F.array("src", "dst").alias("turns"), F.concat(F.array("src"), "inner", F.array("dst")).alias("nodes"))
    while True:
        grown = paths.join(step, "last").where((F.col("dst") == F.col("root")) | ((F.col("dst") > F.col("root")) & ~F.array_contains("turns", F.col("dst"))))
        shut = F.col("dst") == F.col("root")
        grown = grown.select("root", F.col("dst").alias("last"), F.array_append("turns", F.col("dst")).alias("turns"), F.when(shut, F.concat("nodes", "inner")).otherwise(F.concat("nodes", "inner", F.array("dst"))).alias("nodes"), shut.alias("shut"))
        grown = materialize(grown.where(F.size("nodes") <= max_len) if max_len else grown)
        found = found.unionByName(grown.where("shut").select("nodes"))
        paths = grown.where("not shut").drop("shut")
        if paths.isEmpty():
            break
    found = reduce(DataFrame.unionByName, at_hubs, found)
    at = F.array_position("nodes", F.array_min("nodes")).cast("int")
    turned = F.concat(F.slice("nodes", at, F.size("nodes")), F.slice("nodes", F.lit(1), at - 1))
    return found.select(F.size("nodes").alias("length"), turned.alias("nodes"))


def circular_3(adj: DataFrame, balances: DataFrame | None = None) -> DataFrame:
    """Three-node cycles a -> b -> c -> a with a the smallest; with balances(node, balance) also the total."""
    e = adj.select("src", "dst").distinct()
    ab, bc, ca = e.toDF("a", "b"), e.toDF("b", "c"), e.toDF("c", "a")
    out = ab.where("a < b").join(bc.where("b <> c"), "b").where("a < c").join(ca, ["c", "a"]).select("a", "b", "c")
    if balances is not None:
        for x in "abc":
            out = out.join(balances.select(F.col("node").alias(x), F.col("balance").alias(f"balance_{x}")), x, "left")
        out = out.withColumn("total", reduce(Column.__add__, [F.coalesce(f"balance_{x}", F.lit(0.0)) for x in "abc"]))
    return out


def shared_controllers(edges: DataFrame, least: int = 2) -> DataFrame:
    """(source, companies): controllers of at least ``least`` distinct companies."""
    return edges.groupBy("source").agg(F.array_sort(F.collect_set("target")).alias("companies")).where(F.size("companies") >= least)


def shareholder_hubs(edges: DataFrame, least: int = 3) -> DataFrame:
    """(target, shareholders): companies with at least ``least`` distinct shareholders."""
    return edges.groupBy("target").agg(F.array_sort(F.collect_set("source")).alias("shareholders")).where(F.size("shareholders") >= least)


def guarantee_chain(gar: DataFrame, pre: DataFrame, guarantor: str | None = None, allow_return: bool = True) -> DataFrame:
    """Two-hop chains a -> b -> c whose last loan is VENCIDO; the two guarantees are different edges."""
    h = guarantee_hops(gar, pre)
    first = h.select(F.col("edge_id").alias("e1"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("id_prestamo").alias("loan_1"))
    last = pre.where("estatus = 'VENCIDO'").select(F.col("id_prestamo").alias("loan_2"), F.col("saldo_vigente_mxn").alias("balance"), "dias_mora")
    second = h.select(F.col("edge_id").alias("e2"), F.col("src").alias("b"), F.col("dst").alias("c"), F.col("id_prestamo").alias("loan_2")).join(last, "loan_2")
    out = first.join(second, "b").where("e1 <> e2")
    out = out if allow_return else out.where("a <> c")
    return (out.where(F.col("a") == guarantor) if guarantor else out).select("a", "b", "c", "loan_1", "loan_2", "balance", "dias_mora")


def hops_with_loans(gar: DataFrame, pre: DataFrame) -> DataFrame:
    """``guarantee_hops`` with the state, balance and days past due of the guaranteed loan, as ``sinks.store_hops`` keeps them."""
    return guarantee_hops(gar, pre).join(pre.select("id_prestamo", "estatus", "saldo_vigente_mxn", "dias_mora"), "id_prestamo")


def stored_adjacency(spark: SparkSession, name: str) -> DataFrame:
    """``guarantee_adjacency`` over the tables of ``sinks.store_hops``, without a shuffle."""
    return spark.table(f"{name}_by_src").select("src", "dst").distinct()


def stored_chain(spark: SparkSession, name: str, guarantor: str | None = None) -> DataFrame:
    """``guarantee_chain`` over the tables of ``sinks.store_hops``, without a shuffle."""
    first = spark.table(f"{name}_by_dst").select(F.col("edge_id").alias("e1"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("id_prestamo").alias("loan_1"))
    second = spark.table(f"{name}_by_src").where("estatus = 'VENCIDO'").select(F.col("edge_id").alias("e2"), F.col("src").alias("b"), F.col("dst").alias("c"), F.col("id_prestamo").alias("loan_2"), F.col("saldo_vigente_mxn").alias("balance"), "dias_mora")
    out = first.join(second, "b").where("e1 <> e2")
    return (out.where(F.col("a") == guarantor) if guarantor else out).select("a", "b", "c", "loan_1", "loan_2", "balance", "dias_mora")


def guarantors_of(gar: DataFrame, pre: DataFrame, debtors: DataFrame | None = None, max_depth: int = 4) -> DataFrame:
    """(debtor, guarantor, depth): everyone who stands behind a debtor within ``max_depth`` hops."""
    back = guarantee_adjacency(gar, pre).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reachable(back, debtors, max_depth).select(F.col("start").alias("debtor"), F.col("node").alias("guarantor"), "depth")


def guarantor_figures(gar: DataFrame, pre: DataFrame, loans: DataFrame | None = None, max_depth: int = 4) -> DataFrame:
    """(debtor, guarantor, depth, id_prestamo, balance, pd): everyone who stands behind a loan within ``max_depth`` guarantees.

    The first hop leads from the loan to its guarantors, each further one to those of a guarantor's own loans.
    """
    direct = guarantee_hops(gar, pre).select(F.col("id_prestamo").alias("src"), F.col("src").alias("dst"))
    back = guarantee_adjacency(gar, pre).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    starts = loans.select("id_prestamo") if loans is not None else direct.select("src")
    own = pre.select(F.col("id_prestamo").alias("start"), F.col("id_titular").alias("debtor"), F.col("saldo_vigente_mxn").alias("balance"), F.col("probabilidad_incumplimiento").alias("pd"))
    behind = reach_pairs(bounded_reach(direct.unionByName(back), starts, max_depth), own).withColumnsRenamed({"start": "id_prestamo", "node": "guarantor"})
    return behind.where("guarantor <> debtor").select("debtor", "guarantor", "depth", "id_prestamo", "balance", "pd")


def render_path(paths: DataFrame, nodes: DataFrame, col: str = "nodes") -> DataFrame:
    """``paths`` with ``route``: the names, or where there is none the ids, of the nodes in ``col``, in order.

    Equal paths are named once; nodes(id, name) may lack some.
    """
    step = paths.select(col).distinct().select(col, F.posexplode(col).alias("at", "id"))
    names = nodes.select("id", "name").groupBy("id").agg(F.min("name").alias("name"))
    named = step.join(names, "id", "left").select(col, F.struct("at", F.coalesce("name", "id").alias("name")).alias("x"))
    routes = named.groupBy(col).agg(F.sort_array(F.collect_list("x"))["name"].alias("route"))
    return paths.join(routes, col, "left").select(*paths.columns, "route")


def related_parties(control: DataFrame, group: str = "id_empresa", member: str = "id_individuo", tile: int = 1000) -> DataFrame:
    """Unordered pairs of members of one group, whatever its size.

    Members are dealt into tiles of about ``tile`` by hash, and pairs of tiles are joined, each pair of tiles once, so a
    group of n members is n squared over tile squared tasks' work and no task meets more than two tiles. The pairs themselves
    grow with the square; ``party_counts`` gives their number without them.
    """
    m = control.select(F.col(group).alias("g"), F.col(member).alias("m")).where("g is not null and m is not null").distinct()
    tiles = m.groupBy("g").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    m = m.join(tiles, "g").withColumn("t", F.pmod(F.xxhash64("m"), F.col("tiles")).cast("int"))
    # tile t meets the tiles from t on: as the row tile it goes to (t, t), (t, t + 1), .., as the column tile to (0, t), .., (t, t)
    left = m.select("g", F.col("m").alias("x"), F.col("t").alias("row"), F.explode(F.sequence("t", F.col("tiles") - 1)).alias("col"))
    right = m.select("g", F.col("m").alias("y"), F.explode(F.sequence(F.lit(0), F.col("t"))).alias("row"), F.col("t").alias("col"))
    pairs = left.join(right, ["g", "row", "col"]).where("row < col or x < y")
    return pairs.select(F.col("g").alias(group), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def party_counts(control: DataFrame, group: str = "id_empresa", member: str = "id_individuo") -> DataFrame:
    """(group, members, pairs): the members of each group and the number of their unordered pairs; with the membership it says all pairs."""
    m = control.where(F.col(group).isNotNull() & F.col(member).isNotNull()).groupBy(group).agg(F.countDistinct(member).alias("members"))
    return m.withColumn("pairs", F.expr("members * (members - 1) div 2"))


def open_balance(pre: DataFrame) -> DataFrame:
    """(id, loans, total cents) of open loans by holder."""
    return pre.where(is_open()).groupBy(F.col("id_titular").alias("id")).agg(F.count("*").alias("n"), F.sum(cents("saldo_vigente_mxn")).alias("c"))


def contagion_hub(rel: DataFrame, pre: DataFrame, gar: DataFrame, company: str | None = None) -> DataFrame:
    """Per company: related persons, their own open loans and the open loans that they guarantee, each loan once."""
    ties = rel.where(F.col("tipo_relacion").isin("ACCIONISTA", "DIRECTOR")).select("id_empresa", F.col("id_individuo").alias("id")).distinct()
    ties = ties.where(F.col("id_empresa") == company) if company else ties
    people = ties.groupBy("id_empresa").agg(F.countDistinct("id").alias("persons"))
    own = ties.join(open_balance(pre), "id").groupBy("id_empresa").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    loans = pre.where(is_open()).select("id_prestamo", cents("saldo_vigente_mxn").alias("c"))
    backed = ties.join(gar.select(F.col("id_garante").alias("id"), "id_prestamo").distinct(), "id").select("id_empresa", "id_prestamo").distinct().join(loans, "id_prestamo")
    backed = backed.groupBy("id_empresa").agg(F.count("*").alias("bn"), F.sum("c").alias("bc"))
    out = people.join(own, "id_empresa", "left").join(backed, "id_empresa", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("id_empresa", "persons", zero("n").alias("personal_loans"), pesos(F.col("c")).alias("personal_exposure"), zero("bn").alias("guaranteed_loans"), pesos(F.col("bc")).alias("guaranteed_exposure"))


def company_loans(pre: DataFrame, emp: DataFrame, company: str | None = None) -> DataFrame:
    rows = pre.join(emp.select("id_empresa", "razon_social"), F.col("id_titular") == F.col("id_empresa"))
    return (rows.where(F.col("id_empresa") == company) if company else rows).select("id_empresa", "razon_social", "id_prestamo", "estatus", "saldo_vigente_mxn")


def hub_exposure(rel: DataFrame, pre: DataFrame, least: int = 3) -> DataFrame:
    """Per hub company: open loans of the company and its shareholders, each once."""
    edges = rel.where("tipo_relacion = 'ACCIONISTA'").select(F.col("id_individuo").alias("source"), F.col("id_empresa").alias("target"))
    hubs = shareholder_hubs(edges, least).select("target", F.explode(F.array_append("shareholders", F.col("target"))).alias("id"))
    out = hubs.distinct().join(open_balance(pre), "id").groupBy("target")
    return out.agg(F.countDistinct("id").alias("borrowers"), F.sum("n").alias("loans"), pesos(F.sum("c")).alias("exposure")).withColumnRenamed("target", "id_empresa")


def controller_holdings(rel: DataFrame, pre: DataFrame, person: str | None = None) -> DataFrame:
    """Open loans of the companies in which a person holds shares or a seat."""
    ties = rel.where(F.col("tipo_relacion").isin("ACCIONISTA", "DIRECTOR")).select("id_individuo", "id_empresa", "tipo_relacion", "porcentaje_participacion")
    ties = ties.where(F.col("id_individuo") == person) if person else ties
    return ties.join(pre.where(is_open()).select("id_titular", "id_prestamo", "saldo_vigente_mxn"), F.col("id_empresa") == F.col("id_titular")).drop("id_titular")


def person_exposure(cli: DataFrame, pre: DataFrame) -> DataFrame:
    """Every person with count and sum of open personal loans, 0 when there are none."""
    return cli.select("id_cliente", "nombre_completo").join(open_balance(pre), F.col("id_cliente") == F.col("id"), "left").select("id_cliente", "nombre_completo", F.coalesce("n", F.lit(0)).alias("loans"), pesos(F.col("c")).alias("exposure"))


def concentration_risk(rel: DataFrame, pre: DataFrame, least: int = 2, kinds: tuple[str, ...] = ("ACCIONISTA", "DIRECTOR")) -> DataFrame:
    """Controllers of several companies: companies, their open exposure, the person's own, and the sum of both."""
    ties = rel.where(F.col("tipo_relacion").isin(*kinds)).select(F.col("id_individuo").alias("person"), F.col("id_empresa").alias("id")).distinct()
    firms = ties.join(open_balance(pre), "id", "left").groupBy("person").agg(F.countDistinct("id").alias("companies"), F.sum("n").alias("n"), F.sum("c").alias("c")).where(F.col("companies") >= least)
    own = open_balance(pre).select(F.col("id").alias("person"), F.col("c").alias("own"))
    out = firms.join(own, "person", "left")
    total = F.coalesce("c", F.lit(0)) + F.coalesce("own", F.lit(0))
    return out.select(F.col("person").alias("id_cliente"), "companies", F.coalesce("n", F.lit(0)).alias("corporate_loans"), pesos(F.col("c")).alias("corporate_exposure"), pesos(F.col("own")).alias("personal_exposure"), pesos(total).alias("true_concentration"))


def shared_director_loans(rel: DataFrame, pre: DataFrame, least: int = 2) -> DataFrame:
    """Loans of companies that share a director with another company."""
    seats = rel.where("tipo_relacion = 'DIRECTOR'").select(F.col("id_individuo").alias("source"), F.col("id_empresa").alias("target"))
    firms = shared_controllers(seats, least).select(F.col("source").alias("director"), F.explode("companies").alias("id_titular"))
    return firms.join(pre.select("id_titular", "id_prestamo", "estatus", "saldo_vigente_mxn"), "id_titular").withColumnRenamed("id_titular", "id_empresa")


def guaranteed_exposure(gar: DataFrame, pre: DataFrame) -> DataFrame:
    """Guaranteed balance per guarantee edge and per distinct loan, with guarantors and loans."""
    rows = gar.select("id_garante", "id_prestamo").join(pre.select("id_prestamo", cents("saldo_vigente_mxn").alias("c")), "id_prestamo")
    edge = rows.agg(pesos(F.sum("c")).alias("per_edge"), F.countDistinct("id_garante").alias("guarantors"))
    loan = rows.select("id_prestamo", "c").distinct().agg(pesos(F.sum("c")).alias("distinct_loan"), F.count("*").alias("loans"))
    return edge.join(loan)  # one row each


def contagion_by_guarantor(gar: DataFrame, pre: DataFrame, days: int = 90) -> DataFrame:
    """Per guarantor the defaulted loans that they actively guarantee."""
    bad = pre.where((F.col("estatus") == "VENCIDO") & (F.col("dias_mora") > days)).select("id_prestamo", cents("saldo_vigente_mxn").alias("c"))
    rows = gar.where(F.upper("activa") == "TRUE").select("id_garante", "id_prestamo").distinct().join(bad, "id_prestamo")
    return rows.groupBy("id_garante").agg(F.array_join(F.array_sort(F.collect_set("id_prestamo")), ",").alias("loans"), pesos(F.sum("c")).alias("defaulted"), F.count("*").alias("n"))


def weighted_exposure(gar: DataFrame, pre: DataFrame) -> DataFrame:
    """Balance times coverage of active guarantees, by guarantor (whole percent, whole cents)."""
    share = F.round(F.col("cobertura_porcentaje") * 100).cast("bigint")
    rows = gar.where(F.upper("activa") == "TRUE").select("id_garante", "id_prestamo", share.alias("s")).join(pre.select("id_prestamo", cents("saldo_vigente_mxn").alias("c")), "id_prestamo")
    return rows.groupBy("id_garante").agg((F.sum(F.col("c") * F.col("s")) / F.lit(10000.0)).alias("weighted_exposure"), F.count("*").alias("guarantees"))


def correlated_entities(rel: DataFrame, gar: DataFrame, pre: DataFrame, company: str | None = None) -> DataFrame:
    """(id_empresa, role, entity): a company's shareholders, their loans, and guarantees among the shareholders."""
    s = rel.where("tipo_relacion = 'ACCIONISTA'").select("id_empresa", F.col("id_individuo").alias("id")).distinct()
    s = s.where(F.col("id_empresa") == company) if company else s
    firms = s.select("id_empresa").distinct()
    loans = s.unionByName(firms.withColumn("id", F.col("id_empresa"))).join(pre.select(F.col("id_titular").alias("id"), "id_prestamo"), "id")
    h = guarantee_hops(gar, pre)
    cross = s.select("id_empresa", F.col("id").alias("src")).join(h, "src").join(s.select("id_empresa", F.col("id").alias("dst")), ["id_empresa", "dst"])
    role = lambda df, r, c: df.select("id_empresa", F.lit(r).alias("role"), F.col(c).alias("entity"))
    return reduce(DataFrame.unionByName, [role(firms, "company", "id_empresa"), role(s, "shareholder", "id"), role(loans, "loan", "id_prestamo"), role(cross, "guarantee", "edge_id")]).distinct()


def risk_profile(cli: DataFrame, pre: DataFrame, gar: DataFrame, state: str | None, min_pd: float) -> DataFrame:
    """Persons (of a state) with an open loan above the PD and an active guarantee given."""
    risky = pre.where(is_open() & (F.col("probabilidad_incumplimiento") > min_pd)).select(F.col("id_titular").alias("id_cliente"))
    backing = gar.where(F.upper("activa") == "TRUE").select(F.col("id_garante").alias("id_cliente"))
    rows = cli.where(F.col("estado_residencia") == state) if state else cli
    return rows.join(risky, "id_cliente", "left_semi").join(backing, "id_cliente", "left_semi").select("id_cliente", "nombre_completo", "estado_residencia")


def default_impact(gar: DataFrame, pre: DataFrame, persons: DataFrame | None = None, max_depth: int = 4) -> DataFrame:
    """(person, affected, exposure, affected_exposure): who stands behind each person within four hops, the person's open balance and theirs."""
    balance = open_balance(pre).select("id", "c")
    back = guarantee_adjacency(gar, pre).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    who = reach_sums(bounded_reach(back, persons, max_depth), balance.withColumnsRenamed({"id": "node", "c": "weight"})).toDF("person", "affected", "theirs")
    return who.join(balance, F.col("person") == F.col("id"), "left").select("person", "affected", pesos(F.col("c")).alias("exposure"), pesos(F.col("theirs")).alias("affected_exposure"))


def connected_exposure(rel: DataFrame, pre: DataFrame, company: str | None = None) -> DataFrame:
    """Per company the persons with shares or a seat, and the sum of their open personal loans."""
    ties = rel.where(F.col("tipo_relacion").isin("ACCIONISTA", "DIRECTOR")).select("id_empresa", F.col("id_individuo").alias("id")).distinct()
    ties = ties.where(F.col("id_empresa") == company) if company else ties
    out = ties.join(open_balance(pre), "id", "left").groupBy("id_empresa")
    return out.agg(F.count("*").alias("persons"), F.coalesce(F.sum("n"), F.lit(0)).alias("loans"), pesos(F.sum("c")).alias("exposure"))


def incident_edges(edges: DataFrame, nodes: DataFrame | str) -> DataFrame:
    """(node, direction, edge_type, other): edges at a node, or at each of a table of nodes, in both directions; a loop is listed twice."""
    ids = edges.sparkSession.createDataFrame([(nodes,)], "node string") if isinstance(nodes, str) else nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    side = lambda near, far, name: edges.join(ids, F.col(near) == F.col("node")).select("node", F.lit(name).alias("direction"), "edge_type", F.col(far).alias("other"))
    return side("src", "dst", "out").unionByName(side("dst", "src", "in"))


def has_pattern(rows: DataFrame) -> bool:
    """Whether a pattern occurs at all; stops at its first row."""
    return not rows.isEmpty()


def portfolio_gap(pre: DataFrame, gar: DataFrame, rel: DataFrame) -> DataFrame:
    """(metric, value): what a loan table shows, and what the graph adds."""
    one = lambda df, metric, c: df.select(F.lit(metric).alias("metric"), F.col(c).cast("double").alias("value"))
    over, backed = portfolio_overview(pre), guaranteed_exposure(gar, pre)
    risk = concentration_risk(rel, pre)
    rings = circular_3(guarantee_adjacency(gar, pre)).agg(F.count("*").alias("n"))
    return reduce(DataFrame.unionByName, [
        one(over, "loans", "loans"), one(over, "balance", "balance"), one(over, "npl_percent", "npl_percent"), one(backed, "guaranteed_distinct_loan", "distinct_loan"),
        one(backed, "guaranteed_per_edge", "per_edge"), one(unsecured_active(pre, gar), "unsecured_active", "exposure"), one(rings, "circular_3", "n"),
        one(risk.agg(F.count("*").alias("n")), "multi_company_controllers", "n")])


def bipartite(persons: DataFrame, rels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, type), edges(u, v)) of persons and companies; rels(person_id, company_ref)."""
    edges = rels.where("person_id is not null and company_ref is not null").select(F.col("person_id").alias("u"), F.col("company_ref").alias("v")).distinct()
    nodes = persons.select(F.col("person_id").alias("id"), F.lit("person").alias("type")).unionByName(edges.select(F.col("v").alias("id"), F.lit("company").alias("type"))).distinct()
    return nodes, edges


def component_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, size, persons, companies); a node without edges is its own component."""
    c = connected_components(edges)
    rows = nodes.join(c, nodes.id == c.node, "left").withColumn("component", F.coalesce("component", "id"))
    return rows.groupBy("component").agg(F.count("*").alias("size"), F.count_if(F.col("type") == "person").alias("persons"), F.count_if(F.col("type") == "company").alias("companies"))


def components_by_size(sizes: DataFrame, top: int | None = None) -> DataFrame:
    """Components from the largest down, ties by their name; with ``top`` only so many."""
    out = sizes.orderBy(F.desc("size"), "component")
    return out.limit(top) if top else out


def degree_histogram(edges: DataFrame, side: str, nodes: DataFrame | None = None, limits: tuple[int, ...] = (1, 2, 5)) -> DataFrame:
    """(bucket, n): nodes by number of distinct neighbours; 0 needs the table of all nodes."""
    other = next(c for c in edges.columns if c != side)
    d = edges.select(side, other).distinct().groupBy(F.col(side).alias("node")).agg(F.count("*").alias("d"))
    if nodes is not None:
        d = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct().join(d, "node", "left").select("node", F.coalesce("d", F.lit(0)).alias("d"))
    bucket, low = F.when(F.col("d") == 0, "0"), 1
    for top in limits:
        bucket = bucket.when(F.col("d") <= top, str(top) if top == low else f"{low}-{top}")
        low = top + 1
    return d.groupBy(bucket.otherwise(f"{low}+").alias("bucket")).agg(F.count("*").alias("n"))
