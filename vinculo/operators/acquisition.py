"""Ownership data: controllers, corporate groups, subgraph selection, hierarchy layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vinculo.functions.columns import assign_ids, company_number, region_code, sector_of
from vinculo.operators.graph import bipartite, component_sizes


def first_rows(df: DataFrame, keys: list[str], order: list[str], k: int = 1) -> DataFrame:
    """The first k rows of each key in the given order, which must decide ties."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= k).drop("__rn")


def multi_company_controllers(names: DataFrame, statements: DataFrame, least: int = 2, top: int | None = None) -> DataFrame:
    """Persons (fullname, birthdate) named by statements of ``least`` or more distinct companies."""
    rows = names.select("statement_id", "fullname").join(statements.select("statement_id", "birthdate", "company_ref"), "statement_id")
    out = rows.groupBy("fullname", "birthdate").agg(F.countDistinct("company_ref").alias("company_count")).where(F.col("company_count") >= least)
    return out.orderBy(F.desc("company_count"), "fullname", "birthdate").limit(top) if top else out


def find_controllers(names: DataFrame, statements: DataFrame, wanted: DataFrame | list[str], least: int = 2, top: int | None = None) -> DataFrame:
    """``multi_company_controllers`` of the wanted names: a short list, or a table whose first column holds them."""
    if isinstance(wanted, DataFrame):
        some = names.join(wanted.select(F.col(wanted.columns[0]).alias("fullname")).distinct(), "fullname", "left_semi")
    else:
        some = names.where(F.col("fullname").isin(wanted))
    return multi_company_controllers(some, statements, least, top)


def append_companies(existing: DataFrame, new: DataFrame, order: list[str], width: int = 5) -> DataFrame:
    """``existing`` and after it ``new`` with ids that go on from there; columns that ``new`` lacks are null, others are left out."""
    rows = assign_ids(new, "EMP", order, existing, "id_empresa", width)
    return existing.unionByName(rows.select(*[c for c in existing.columns if c in rows.columns]), allowMissingColumns=True)


def lookup(df: DataFrame, names: DataFrame, on: str, default: str) -> DataFrame:
    """``df`` with the name of ``on`` from names(id, name), or the default."""
    return df.join(names.select(F.col("id").alias("__id"), "name"), F.col(on) == F.col("__id"), "left").withColumn("name", F.coalesce("name", F.lit(default))).drop("__id")


def corporate_groups(rel: DataFrame, entities: DataFrame, least_named: int = 3) -> DataFrame:
    """(parent_lei, children, named): parents by number of children; only parents among the entities with enough named children."""
    edges = rel.select("child_lei", "parent_lei").distinct()
    named = entities.where("legal_name <> ''").select(F.col("lei").alias("child_lei"), F.lit(1).alias("named"))
    sizes = edges.join(named, "child_lei", "left").groupBy("parent_lei").agg(F.count("*").alias("children"), F.count("named").alias("named"))
    return sizes.join(entities.select(F.col("lei").alias("parent_lei")), "parent_lei", "left_semi").where(F.col("named") >= least_named)


def hierarchy_layer(rel: DataFrame, entities: DataFrame, groups: DataFrame, children: int = 5, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(companies, relations): each group's parent and its first children as companies, tied as subsidiaries with share 1.

    A child takes the sector of its own name's last keyword, else the parent's.
    """
    e = entities.select("lei", "legal_name", "address_region")
    tops = groups.select(F.col("parent_lei").alias("lei")).join(e, "lei")
    parents = tops.select("lei", F.col("legal_name").alias("razon_social"), sector_of(F.col("legal_name")).alias("sector"), region_code(F.col("address_region"), "CDMX").alias("estado_registro"), F.lit(0).alias("_level"))
    picked = rel.select("child_lei", "parent_lei").distinct().join(groups.select("parent_lei"), "parent_lei", "left_semi").join(e.where("legal_name <> ''"), F.col("child_lei") == F.col("lei"))
    picked = first_rows(picked, ["parent_lei"], ["child_lei"], children)
    sector = parents.select(F.col("lei").alias("parent_lei"), F.col("sector").alias("parent_sector"))
    kids = picked.join(sector, "parent_lei").select("lei", F.col("legal_name").alias("razon_social"), sector_of(F.col("legal_name"), F.col("parent_sector"), last=True).alias("sector"), region_code(F.col("address_region")).alias("estado_registro"), F.lit(1).alias("_level"))
    rows = first_rows(parents.unionByName(kids), ["lei"], ["_level"])
    firms = assign_ids(rows, "EMP", ["_level", "lei"], existing, "id_empresa")
    ids = firms.select("lei", "id_empresa")
    ties = picked.select("child_lei", "parent_lei").join(ids.withColumnsRenamed({"lei": "child_lei", "id_empresa": "id_individuo"}), "child_lei").join(ids.withColumnsRenamed({"lei": "parent_lei"}), "parent_lei")
    ties = ties.select("id_individuo", "id_empresa", F.lit("SUBSIDIARIA").alias("tipo_relacion"), F.lit(1.0).alias("porcentaje_participacion"))
    return firms.drop("_level"), ties


def select_subgraph(persons: DataFrame, rels: DataFrame, companies: int, people: int) -> tuple[DataFrame, DataFrame]:
    """(companies(company_ref), persons(person_id)): a connected part of an ownership graph.

    Companies with several controllers come first, then companies of the persons that these
    select, then those of the largest components, up to the target; then the controllers of the
    selected companies, filled up with the persons of most companies. Order within a stage is by
    component size and id, so the choice is repeatable; the budgets are ranked, so the result is small.
    """
    nodes, edges = bipartite(persons, rels)
    e = edges.select(F.col("u").alias("person_id"), F.col("v").alias("company_ref"))
    deg = e.groupBy("company_ref").agg(F.count("*").alias("controllers"))
    shared = deg.where("controllers > 1").select("company_ref")
    near = e.join(e.join(shared, "company_ref", "left_semi").select("person_id").distinct(), "person_id", "left_semi").select("company_ref").distinct()
    from vinculo.functions.components import connected_components

    comp = connected_components(edges)
    sizes = comp.groupBy("component").agg(F.count("*").alias("size"))
    ranked = deg.join(comp.select(F.col("node").alias("company_ref"), "component"), "company_ref").join(sizes, "component")
    ranked = ranked.join(shared.withColumn("s", F.lit(0)), "company_ref", "left").join(near.withColumn("t", F.lit(1)), "company_ref", "left").withColumn("stage", F.coalesce("s", "t", F.lit(2)))
    chosen = ranked.orderBy("stage", F.desc("size"), "component", "company_ref").limit(companies).select("company_ref")
    held = e.join(chosen, "company_ref", "left_semi").groupBy("person_id").agg(F.count("*").alias("in_chosen"))
    total = e.groupBy("person_id").agg(F.count("*").alias("n"))
    who = total.join(held, "person_id", "left").orderBy(F.desc_nulls_last("in_chosen"), F.desc("n"), "person_id").limit(people).select("person_id")
    return chosen, who


def subgraph_edges(rels: DataFrame, companies: DataFrame, persons: DataFrame, subsidiaries: DataFrame) -> DataFrame:
    """Control edges between selected ends, and all subsidiary edges, in one shape."""
    kept = rels.join(companies, "company_ref", "left_semi").join(persons, "person_id", "left_semi")
    control = kept.select(F.col("person_id").alias("from_id"), F.lit("PERSON").alias("from_type"), F.col("company_ref").alias("to_id"), F.lit("COMPANY").alias("to_type"), F.lit("CONTROLS").alias("rel_type"), F.lit("ACTIVE").alias("rel_status"))
    return control.unionByName(subsidiaries.select(F.col("child_lei").alias("from_id"), F.lit("COMPANY").alias("from_type"), F.col("parent_lei").alias("to_id"), F.lit("COMPANY").alias("to_type"), F.lit("IS_SUBSIDIARY_OF").alias("rel_type"), "rel_status"))


def subgraph_stats(persons: DataFrame, rels: DataFrame) -> DataFrame:
    """One row of connectivity figures of an ownership graph."""
    nodes, edges = bipartite(persons, rels)
    c = component_sizes(nodes, edges).agg(F.count("*").alias("components"), F.coalesce(F.max("size"), F.lit(0)).alias("largest_component"))
    per_person = edges.groupBy("u").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("multi_company_persons"), F.round(F.coalesce(F.sum("n"), F.lit(0)) / F.greatest(F.count("*"), F.lit(1)), 2).alias("mean_companies"), F.coalesce(F.max("n"), F.lit(0)).alias("max_companies"))
    per_firm = edges.groupBy("v").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("shared_companies"), F.round(F.coalesce(F.sum("n"), F.lit(0)) / F.greatest(F.count("*"), F.lit(1)), 2).alias("mean_controllers"))
    kinds = nodes.agg(F.count_if(F.col("type") == "person").alias("persons"), F.count_if(F.col("type") == "company").alias("companies"))
    out = kinds.join(edges.agg(F.count("*").alias("edges")))
    for one_row in (c, per_person, per_firm):
        out = out.join(one_row)
    return out


def company_numbers(rels: DataFrame) -> DataFrame:
    return rels.withColumn("company_number", company_number(F.col("company_ref")))
