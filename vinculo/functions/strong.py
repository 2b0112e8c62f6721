"""Strongly connected components of a directed edge table, and reach counted over the components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculo.functions.components import connected_components
from vinculo.functions.prefix import ranked
from vinculo.functions.runtime import materialize

#: Relaxations of labels between two writes, and rounds of trimming between two colourings.
HOPS, TRIMS = 3, 3
#: Folders of hops that a flood reads before they become one.
FOLDERS = 8


def clean_edges(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) without nulls and loops, written once."""
    return materialize(edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct())


def spread(labels: DataFrame, edges: DataFrame, hops: int = HOPS) -> DataFrame:
    """(node, label): for each node the smallest label among itself and the nodes that have a path to it.

    Only labels that fell in the last step are sent on, and a write follows every ``hops`` steps.
    """
    state = labels.select("node", "label", F.lit(True).alias("fell"))
    while True:
        step = state
        for _ in range(hops):
            sent = step.where("fell").join(edges, F.col("node") == F.col("src")).groupBy("dst").agg(F.min("label").alias("sent"))
            step = step.join(sent, F.col("node") == F.col("dst"), "left").select("node", F.least("label", "sent").alias("label"), F.coalesce(F.col("sent") < F.col("label"), F.lit(False)).alias("fell"))
        state = materialize(step, state)
        if state.where("fell").isEmpty():
            return state.select("node", "label")


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(short(src, dst, head), inner(node, head, place)) of distinct ``edges`` without loops: runs of nodes without a choice become one edge.

    A run is nodes that each have one edge in and one out; its edge leads from the node before its first to the one after
    its last and carries the run's first node as ``head``; edges of no run have a null head. A ring of such nodes alone
    becomes a loop at its smallest node. Places in a run come from pointer doubling, so n nodes in a row take log n rounds.
    """
    out, into = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"), F.min("dst").alias("next")), edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"), F.min("src").alias("prev"))
    plain = materialize(out.join(into, "node").where("o = 1 and i = 1").select("node", "prev", "next"))
    linked = plain.join(plain.select(F.col("node").alias("prev")), "prev", "left_semi")
    member = connected_components(linked.select(F.col("node").alias("u"), F.col("prev").alias("v")))
    headed = member.join(linked.select("node"), "node", "left_anti").select("component").distinct()
    anchors = member.where("node = component").join(headed, "component", "left_anti").select("node")
    plain = materialize(plain.join(anchors, "node", "left_anti"), plain)
    back = plain.join(plain.select(F.col("node").alias("prev"), F.lit(True).alias("run")), "prev", "left")
    # at: the node of the run that lies ``place`` nodes before; the first leads to itself
    state = materialize(back.select("node", F.when(F.col("run"), F.col("prev")).otherwise(F.col("node")).alias("at"), F.when(F.col("run"), 1).otherwise(0).alias("place"), F.lit(True).alias("moved")))
    while not state.where("moved").isEmpty():
        on = state.select(F.col("node").alias("at"), F.col("at").alias("further"), F.col("place").alias("more"))
        state = materialize(state.join(on, "at").select("node", F.col("further").alias("at"), (F.col("place") + F.col("more")).alias("place"), (F.col("more") > 0).alias("moved")), state)
    inner = state.select("node", F.col("at").alias("head"), "place")
    first, last = F.min_by("prev", "place"), F.max_by("next", "place")
    runs = inner.join(plain, "node").groupBy("head").agg(first.alias("src"), last.alias("dst")).select("src", "dst", "head")
    whole = edges.join(plain, F.col("src") == F.col("node"), "left_anti").join(plain, F.col("dst") == F.col("node"), "left_anti")
    return materialize(runs.unionByName(whole.select("src", "dst", F.lit(None).cast(plain.schema["node"].dataType).alias("head")))), inner


def flood(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, back): the one node of ``start(node)`` and all that paths lead to (``back`` false), and it and all that have a path to it.

    Both ways go on in one loop of one join a hop from new nodes only; as each hop is written its size is known, so a small one is
    sent to the edges and those are not shuffled.
    """
    ways = edges.select("src", "dst", F.lit(False).alias("back")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("back")))
    frontier = materialize(start.select("node", F.explode(F.array(F.lit(False), F.lit(True))).alias("back")))
    seen = [frontier]
    while not frontier.isEmpty():
        met = ways.join(frontier.select(F.col("node").alias("src"), "back"), ["src", "back"]).select(F.col("dst").alias("node"), "back").distinct()
        frontier = materialize(met.join(reduce(DataFrame.unionByName, seen), ["node", "back"], "left_anti"))
        seen.append(frontier)
        if len(seen) > FOLDERS:  # few folders to read a hop
            seen = [materialize(reduce(DataFrame.unionByName, seen)), frontier.limit(0)]
    return reduce(DataFrame.unionByName, seen)


def _heart(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, colour) of the component of the node with most edges in times edges out, and the edges that can lie in others.

    What the node reaches and what reaches it is flooded once, as most of a graph with one large component lies there. Another
    component lies whole in what is reached only, in what reaches it only, or in neither.
    """
    out, into = live.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o")), live.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"))
    pivot = materialize(out.join(into, "node").orderBy(F.desc(F.col("o") * F.col("i")), "node").limit(1).select("node"))
    if pivot.isEmpty():
        return pivot.select("node", F.col("node").alias("colour")), live.limit(0)
    way = F.when(F.col("back"), 2).otherwise(1)
    sides = materialize(flood(live, pivot).groupBy("node").agg(F.sum(way).alias("side")))  # 1: reached, 2: reaches, 3: both
    done = sides.where("side = 3").select("node").crossJoin(F.broadcast(pivot.select(F.col("node").alias("colour"))))  # one row
    of = lambda end: sides.select(F.col("node").alias(end), F.col("side").alias(f"s_{end}"))
    both = live.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    side = lambda end: F.coalesce(F.col(f"s_{end}"), F.lit(0))
    return materialize(done), materialize(both.where((side("src") == side("dst")) & (side("src") < 3)).select("src", "dst"))


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges(src, dst)`` with numbers for nodes, in the nodes' order, and names(number, node): numbers are cheaper to move and compare."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    names = materialize(ranked(nodes, ["node"], name="number").select("number", "node"))
    of = lambda end: names.select(F.col("node").alias(end), F.col("number").alias(f"n_{end}"))
    return materialize(edges.join(of("src"), "src").join(of("dst"), "dst").select(F.col("n_src").alias("src"), F.col("n_dst").alias("dst"))), names


def _components(edges: DataFrame) -> DataFrame:
    """``strong_components`` of distinct edges without loops and nulls."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    short, inner = contracted(edges)
    live, found = short.where("src <> dst").select("src", "dst").distinct(), None
    while True:
        for _ in range(TRIMS):  # written each time: a plan that reads itself twice a round would double with each
            into, out = live.select(F.col("dst").alias("node")).distinct(), live.select(F.col("src").alias("node")).distinct()
            live = materialize(live.join(into, F.col("src") == F.col("node"), "left_semi").join(out, F.col("dst") == F.col("node"), "left_semi"))
        if live.isEmpty():
            break
        if found is None:
            found, live = _heart(live)
            continue
        ends = live.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(live.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        rank = F.struct((-F.sum("o") * F.sum("i")).alias("weight"), F.col("node").alias("first")).alias("label")
        coloured = spread(ends.groupBy("node").agg(rank), live).select("node", F.col("label.first").alias("colour"))
        tinted = live.join(coloured.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src").join(coloured.select(F.col("node").alias("dst"), F.col("colour").alias("d")), "dst")
        inside = materialize(tinted.where(F.col("c") == F.col("d")).select("src", "dst"))
        back = spread(coloured.select("node", F.when(F.col("node") == F.col("colour"), 0).otherwise(1).alias("label")), inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        done = materialize(back.where("label = 0").select("node").join(coloured, "node"))
        found = found.unionByName(done)
        rest = done.select("node")
        live = materialize(inside.join(rest, F.col("src") == F.col("node"), "left_anti").join(rest, F.col("dst") == F.col("node"), "left_anti"), inside)
    alone = nodes.select("node", F.col("node").alias("colour"))
    anchors = alone if found is None else alone.join(found.withColumnRenamed("colour", "in"), "node", "left").select("node", F.coalesce("in", "colour").alias("colour"))
    anchors = materialize(anchors)
    of = lambda end: anchors.select(F.col("node").alias(end), F.col("colour").alias(f"c_{end}"))
    closed = short.where("head is not null").join(of("src"), "src").join(of("dst"), "dst").where("c_src = c_dst").select("head", F.col("c_src").alias("run_colour"))
    member = anchors.join(inner.join(closed, "head").select("node", "run_colour"), "node", "left").select("node", F.coalesce("run_colour", "colour").alias("colour"))
    member = materialize(member)
    least = member.groupBy("colour").agg(F.min("node").alias("component"))
    return materialize(member.join(least, "colour").select("node", "component"))


def named(member: DataFrame, names: DataFrame) -> DataFrame:
    """``member(node, component, ..)`` with the nodes' names in place of their numbers."""
    of = lambda c: names.select(F.col("number").alias(c), F.col("node").alias(f"name_{c}"))
    more = [c for c in member.columns if c not in ("node", "component")]
    return member.join(of("node"), "node").join(of("component"), "component").select(F.col("name_node").alias("node"), F.col("name_component").alias("component"), *more)


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges(src, dst)``; component is the smallest node of its strongly connected component.

    Nodes are numbered and runs of nodes without a choice are contracted first; a run belongs to a component if both of its ends do. Nodes
    without an edge in or out are trimmed, some layers a round. The first round floods from the node with most edges in and out, both ways,
    which takes the large component out (``_heart``). In later rounds every node takes as colour the first of the nodes that
    reach it, in an order that puts nodes with many edges in and out first, and the nodes that reach a colour's own node
    within the colour are its component. Edges between colours lie in no component and are dropped, so all colours go on
    at once. Each step is a join over edges; the driver sees no rows. Null ends and loops are ignored; an empty table gives an empty result.
    """
    short, names = numbered(clean_edges(edges))
    return materialize(named(_components(short), names))


def closure(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(start, node, ..): all nodes that paths of any length lead to from each start, over edges without cycles among ``edges(src, dst)``.

    ``starts`` may have a second column ``barred`` and ``edges`` a column ``shut``: starts that are barred do not take edges that are shut.
    HOPS joins from the pairs that are new between two writes.
    """
    roots = (starts.withColumnRenamed(starts.columns[0], "start") if starts is not None else edges.select(F.col("src").alias("start"))).distinct()
    more = roots.columns[1:]
    passable = ~(F.col("barred") & F.col("shut")) if more else F.lit(True)
    seen, frontier = None, roots.select("start", F.col("start").alias("node"), *more)
    while True:
        step, met = frontier, None
        for _ in range(HOPS):
            step = step.join(edges, F.col("node") == F.col("src")).where(passable).select("start", F.col("dst").alias("node"), *more).distinct()
            met = step if met is None else met.unionByName(step)
        met = met.distinct()
        frontier = materialize(met if seen is None else met.join(seen, ["start", "node"], "left_anti"))
        seen = frontier if seen is None else seen.unionByName(frontier)
        if frontier.isEmpty():
            return seen


def reach_counts(edges: DataFrame) -> DataFrame:
    """(node, component, size, reached): how many other nodes paths of any length lead to, without listing the pairs.

    Nodes of one component reach the same nodes, so only pairs of components are sought, over the graph of components, which
    has no cycles. The largest component stands for all that it reaches: a component that reaches it counts that once, and
    lists only what it reaches besides; what the largest reaches is listed for starts that do not reach it. With its
    membership the result says who reaches whom up to those lists (``closure``). Null ends and loops are ignored.
    """
    edges, names = numbered(clean_edges(edges))
    member = _components(edges)
    sizes = materialize(member.groupBy("component").agg(F.count("*").alias("size")))
    of = lambda end: member.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
    dag = materialize(edges.join(of("src"), "src").join(of("dst"), "dst").where("c_src <> c_dst").select(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).distinct())
    hub = sizes.orderBy(F.desc("size"), "component").limit(1).first()
    if hub is None:
        return named(member.select("node", "component", F.lit(0).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("reached")), names)
    one = edges.sparkSession.createDataFrame([(hub.component,)], member.select("component").schema)
    seen = materialize(flood(dag, one.withColumnRenamed("component", "node")).where(F.col("node") != hub.component))
    down, up = seen.where("NOT back").select(F.col("node").alias("component")), seen.where("back").select(F.col("node").alias("component"))
    below = down.join(sizes, "component").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    under = down.unionByName(one).select(F.col("component").alias("dst"), F.lit(True).alias("under"))
    # paths that avoid the largest component and all that it reaches, for the components above it; all paths for the others
    beside = materialize(dag.join(under, "dst", "left").select("src", "dst", F.col("under").isNotNull().alias("shut")))
    starts = sizes.select("component").where(F.col("component") != hub.component).join(up.withColumn("above", F.lit(True)), "component", "left")
    lists = closure(beside, starts.select("component", F.col("above").isNotNull().alias("barred")))
    listed = lists.join(sizes.withColumnRenamed("component", "node"), "node").groupBy(F.col("start").alias("component")).agg(F.sum("size").alias("listed"))
    above = up.withColumn("above", F.lit(True))
    each = sizes.join(listed, "component", "left").join(above, "component", "left")
    whole = F.when(F.col("component") == hub.component, F.lit(below)).when(F.col("above"), F.lit(below + hub["size"])).otherwise(0)
    each = each.select("component", "size", (F.coalesce("listed", F.lit(0)) + whole + F.col("size") - 1).cast("bigint").alias("reached"))
    return named(member.join(each, "component"), names)
