"""Prefix sums, strong components, cycles of any length, reach by classes, pairs by tiles, bootstrap by run, score versions."""

import collections
import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vinculo.functions import prefix, strong
from vinculo.operators import acquisition, exposure, graph, scoring
from vinculo.sources import sinks


def test_ranks_running_sums_and_quantiles(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, 2, 2, 7, 9]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(7)
    got = prefix.ranked(df, ["v", "i"], ["k"]).collect()
    for k in ("a", "b", None):
        own = sorted((v, i) for q, v, i in rows if q == k)
        assert sorted((r.rank, r.v, r.i) for r in got if r.k == k) == [(n + 1, v, i) for n, (v, i) in enumerate(own)]
    assert sorted((r.rank, r.i) for r in prefix.ranked(df, ["i"]).collect()) == [(i + 1, i) for i in range(500)]
    sums = prefix.running(df, ["i"], ["v"], ["k"]).collect()
    want = {(k, i): sum(v for q, v, j in rows if q == k and j <= i) for k, _, i in rows}
    assert {(r.k, r.i): r.v_upto for r in sums} == want
    q = {r.k: r.q for r in prefix.quantiles(df, "v", [0.0, 0.1, 0.5, 0.975, 1.0], ["k"], "q").collect()}
    for k in ("a", "b", None):
        assert q[k] == pytest.approx(np.quantile([v for w, v, _ in rows if w == k], [0.0, 0.1, 0.5, 0.975, 1.0]).tolist())
    assert prefix.quantiles(df.where("false"), "v", [0.5]).count() == 0 and prefix.ranked(df.where("false"), ["v"]).count() == 0
    assert prefix.quantiles(df, "v", [0.5]).first()[0] == [float(np.quantile([v for _, v, _ in rows], 0.5))]


def test_prefix_sums_cross_runs_of_parts(spark):
    parts = spark.range(3000).select(F.col("id").alias("p"), (F.col("id") % 3).alias("n"))
    got = {r.p: r.before for r in prefix.before_parts(parts, "p", "n").collect()}
    assert got == {p: sum(q % 3 for q in range(p)) for p in range(3000)}


def brute(edges):
    out = collections.defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None and a != b:
            out[a].add(b)
    nodes = {x for a in out for x in (a, *out[a])}
    reach = {}
    for n in nodes:
        seen, front = set(), {n}
        while front:
            front = {y for x in front for y in out[x]} - seen
            seen |= front
        reach[n] = seen
    return nodes, out, reach


@pytest.mark.parametrize("seed,n,m", [(1, 40, 60), (3, 30, 90), (4, 50, 40)])
def test_components_reach_and_cycles_equal_brute_force(spark, seed, n, m):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(m)] + [(None, "n01"), ("n01", None), ("n00", "n00")]
    nodes, out, reach = brute(edges)
    comp = {x: min([x, *[y for y in reach[x] if x in reach[y]]]) for x in nodes}
    df = spark.createDataFrame(edges, "src string, dst string")
    assert {r.node: r.component for r in strong.strong_components(df).collect()} == comp
    size = collections.Counter(comp.values())
    got = {r.node: (r.component, r["size"], r.reached) for r in strong.reach_counts(df).collect()}
    assert got == {x: (comp[x], size[comp[x]], len(reach[x] - {x})) for x in nodes}
    if m > 70:
        return  # too many cycles
    found, stack = set(), [(x, (x,)) for x in nodes]
    while stack:
        root, path = stack.pop()
        for y in out[path[-1]]:
            if y == root and len(path) > 1:
                found.add(path)
            elif y > root and y not in path:
                stack.append((root, (*path, y)))
    rows = [tuple(r.nodes) for r in graph.cycles(df).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == found
    assert {tuple(r.nodes) for r in graph.cycles(df, 4).collect()} == {c for c in found if len(c) <= 4}


def test_a_ring_of_a_thousand_is_found(spark):
    ring = [(f"r{i:04d}", f"r{(i + 1) % 1000:04d}") for i in range(1000)]
    tail = [("r0005", "x1"), ("x1", "x2"), ("y", "r0009")]
    rows = graph.cycles(spark.createDataFrame(ring + tail, "src string, dst string")).collect()
    assert [(r.length, list(r.nodes)) for r in rows] == [(1000, [f"r{i:04d}" for i in range(1000)])]
    empty = spark.createDataFrame([], "src string, dst string")
    assert graph.cycles(empty).count() == 0 and strong.strong_components(empty).count() == 0 and strong.reach_counts(empty).count() == 0


def test_pairs_of_a_large_group(spark):
    """Twelve thousand members: the pairs are all there, no pair of tiles is met twice."""
    df = spark.range(12000).select(F.lit("g").alias("id_empresa"), F.format_string("m%05d", "id").alias("id_individuo"))
    pairs = graph.related_parties(df).agg(F.count("*"), F.count_if(F.col("a") < F.col("b"))).first()
    assert tuple(pairs) == (12000 * 11999 // 2,) * 2
    assert [tuple(r) for r in graph.party_counts(df).collect()] == [("g", 12000, 12000 * 11999 // 2)]
    small = spark.createDataFrame([("g", f"m{i}") for i in range(9)] * 2 + [("h", "m1"), (None, "m1"), ("h", None)], "id_empresa string, id_individuo string")
    for tile in (2, 100):
        got = [(r.a, r.b) for r in graph.related_parties(small, tile=tile).collect()]
        assert sorted(got) == sorted(itertools.combinations([f"m{i}" for i in range(9)], 2))


def plain_metrics(y, p):
    order = sorted(set(p), reverse=True)
    pos, neg, tp, fp, auc, ap = sum(y), len(y) - sum(y), 0, 0, 0.0, 0.0
    for s in order:
        a = sum(1 for t, q in zip(y, p, strict=True) if q == s and t)
        b = sum(1 for t, q in zip(y, p, strict=True) if q == s and not t)
        tp, fp = tp + a, fp + b
        auc, ap = auc + b * (tp - a / 2), ap + a * tp / (tp + fp)
    log = [-(math.log(max(q, 1e-15)) if t else math.log(1 - q)) for t, q in zip(y, p, strict=True)]
    return auc / pos / neg, ap / pos, sum((q - t) ** 2 for t, q in zip(y, p, strict=True)) / len(y), sum(log) / len(y)


def test_bootstrap_draws_within_a_run(spark):
    """Two seeds with 10 and 4 groups, some of one class only, against a plain loop; every run has all replicates."""
    rng, rows = random.Random(9), []
    for s, n in ((1, 10), (2, 4)):
        for g in range(n):
            for i in range(6):
                y = int(g == 0 and i < 3) if s == 2 else rng.randrange(2)
                rows += [("c", s, m, 100 * s + g, y, rng.randrange(1, 20) / 20) for m in ("gbt", "other")]
    pred = spark.createDataFrame(rows, "condition string, seed int, model string, group_id int, y int, p double")
    got = scoring.group_bootstrap(pred, ["condition", "seed", "model"], 30).collect()
    assert collections.Counter((r.seed, r.model) for r in got) == {(s, m): 30 for s in (1, 2) for m in ("gbt", "other")}
    have = {(r.seed, r.model, r.replicate): (r.roc_auc, r.average_precision, r.brier, r.log_loss) for r in got}
    for s in (1, 2):
        groups, replicate = sorted({r[3] for r in rows if r[1] == s}), 0
        for attempt in range(600):
            share = [int(hashlib.md5(f"0-c-{s}-{attempt}-{j}".encode()).hexdigest()[:8], 16) / 2**32 for j in range(len(groups))]
            drawn = [groups[int(x * len(groups))] for x in share]
            take = {m: [(r[4], r[5]) for g in drawn for r in rows if r[:4] == ("c", s, m, g)] for m in ("gbt", "other")}
            if len({y for y, _ in take["gbt"]}) < 2:
                continue
            for m, pairs in take.items():
                assert have[s, m, replicate] == pytest.approx(plain_metrics(*zip(*pairs, strict=True)), abs=2e-6)
            replicate += 1
            if replicate == 30:
                break
        assert replicate == 30


def test_logistic_equals_a_newton_solution(spark):
    """The unit L2 penalty on columns of population deviation 1, intercept free."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 3)) * [1.0, 5.0, 0.2] + [0, 3, 1]
    y = (x @ [1.0, -0.3, 2.0] + rng.normal(size=80) > 1).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)], "leverage double, interest_coverage double, cash_buffer double, label int")
    z = np.c_[(x - x.mean(0)) / x.std(0), np.ones(80)]
    w, pen = np.zeros(4), np.diag([1.0, 1, 1, 0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T * (q * (1 - q)) @ z + pen, z.T @ (q - y) + pen @ w)
    model = scoring.fit_logistic(df, scoring.BORROWER_FEATURES)
    got = [r.p for r in scoring.predict(model, df).orderBy("leverage").collect()]
    assert got == pytest.approx((1 / (1 + np.exp(-z @ w)))[np.argsort(x[:, 0])].tolist(), abs=1e-4)


def test_calibrations_and_constant_model(spark):
    rows = [(i, int(i % 4 == 0), 0.3) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, label int, p double")
    assert scoring.constant_model(df) == 0.25 and scoring.constant_model(df.where("false")) == 0.0
    for way in (scoring.calibrate, scoring.platt_raw):  # one score for all: the calibration part's rate
        assert {round(r.p_calibrated, 4) for r in way(df, df).collect()} == {0.25}
    spread = spark.createDataFrame([(i, int(i >= 20 or i % 7 == 0), i / 40) for i in range(40)], "id int, label int, p double")
    p = [r.p_calibrated for r in scoring.platt_raw(spread, spread).orderBy("id").collect()]
    assert p == sorted(p) and p[0] < 0.5 < p[-1]
    top = scoring.compare_scores(scoring.platt_raw(spread, spread), "id", 3).collect()
    assert [r.id for r in top] == [39, 38, 37]
    scored = scoring.score_all(scoring.platt_raw(spread, spread), "v9", "2026-01-01", "gbt", key="id").first()
    assert (scored.score_version, scored.score_fecha, scored.model_name) == ("v9", "2026-01-01", "gbt")


def test_split_membership_and_rows(spark):
    b = spark.range(200).select(F.col("id").alias("borrower_id"), (F.col("id") % 20).alias("group_id"))
    got = scoring.split_membership(b, [3, 4]).collect()
    for s in (3, 4):
        order = sorted(range(20), key=lambda g: hashlib.md5(f"{s}-{g}".encode()).hexdigest())
        part = {g: "train" if n < 12 else "calibration" if n < 16 else "test" for n, g in enumerate(order)}
        assert {(r.borrower_id, r.split) for r in got if r.seed == s} == {(i, part[i % 20]) for i in range(200)}
    shares = collections.Counter(r.split for r in scoring.split_rows(b, "borrower_id").collect())
    assert sum(shares.values()) == 200 and 90 < shares["train"] < 150


def test_sweep_tables_are_complete(spark):
    rng = random.Random(2)
    b = spark.createDataFrame([(i, i // 5, rng.random(), rng.random(), rng.random(), rng.random(), rng.random(), int(rng.random() < 0.4)) for i in range(200)],
                              "borrower_id int, group_id int, balance double, leverage double, interest_coverage double, cash_buffer double, stress double, label int")
    e = spark.createDataFrame([(i, (i + 1) % 200) for i in range(200)], "src int, dst int")
    conditions = {"x": (b, e), "y": (b, e.where("src % 2 = 0"))}
    pred = scoring.run_sweep(conditions, [1, 2], trees=1)
    t = scoring.experiment_tables(pred, 3, scoring.sweep_members(conditions, [1, 2]))
    assert set(t) == {"runs", "raw", "curves", "intervals", "summary", "uplift", "best", "split_counts"}
    assert t["runs"].count() == t["raw"].count() == 16 and t["intervals"].count() == 64 and t["split_counts"].count() == 12
    flat = t["curves"].where("model = 'constant'").collect()
    assert len(flat) == 4 and all(r.bin == 0 for r in flat)
    one = {r.condition: r for r in t["runs"].where("model = 'constant' and seed = 1").collect()}
    assert one["x"].brier == one["y"].brier and one["x"].roc_auc == 0.5


def test_score_versions_are_replaced_not_repeated(spark, tmp_path):
    row = "id_prestamo string, probabilidad_incumplimiento double, score_version string"
    v1, v2 = spark.createDataFrame([("a", 0.1, "1"), ("b", 0.2, "1")], row), spark.createDataFrame([("a", 0.3, "2")], row)
    for scores in (v1, v2, v2, v1):
        sinks.append_scores(scores, str(tmp_path / "s"))
    back = sinks.read_scores(spark, str(tmp_path / "s"), v1.schema)
    assert sorted(map(tuple, back.collect())) == [("a", 0.1, "1"), ("a", 0.3, "2"), ("b", 0.2, "1")]
    assert [r[0] for r in exposure.not_rescored(back, "1", "2").collect()] == ["b"]


def test_patterns_and_edges_at_nodes(spark):
    e = spark.createDataFrame([("T", "a", "b"), ("U", "b", "a"), ("T", "c", "c")], "edge_type string, src string, dst string")
    assert sorted(map(tuple, graph.incident_edges(e, "a").collect())) == [("a", "in", "U", "b"), ("a", "out", "T", "b")]
    assert graph.incident_edges(e, spark.createDataFrame([("a",), ("c",), ("a",)], "n string")).count() == 4
    assert graph.has_pattern(e.where("src = 'a'")) and not graph.has_pattern(e.where("src = 'z'"))


def test_ownership_edges_of_a_selection(spark):
    rels = spark.createDataFrame([("p1", "c1"), ("p1", "c2"), ("p2", "c1")], "person_id string, company_ref string")
    firms, people = spark.createDataFrame([("c1",)], "company_ref string"), spark.createDataFrame([("p1",)], "person_id string")
    subs = spark.createDataFrame([("k", "m", "ACTIVE")], "child_lei string, parent_lei string, rel_status string")
    got = {(r.from_id, r.to_id, r.rel_type) for r in acquisition.subgraph_edges(rels, firms, people, subs).collect()}
    assert got == {("p1", "c1", "CONTROLS"), ("k", "m", "IS_SUBSIDIARY_OF")}


def test_json_records_in_splits(spark, tmp_path):
    """Objects with braces, quotes and backslashes in their texts, over files cut into splits of 2 kB, equal the parsed documents."""
    from vinculo.sources import readers

    rng = random.Random(11)
    text = lambda: "".join(rng.choice(['a', '"', "\\", "{", "}", "[", "]", ",", "é", "\n", " "]) for _ in range(rng.randrange(30)))
    items = [{"id": i, "name": text(), "sub": {"x": text(), "y": [{"z": text()}]}} for i in range(400)]
    plain, paged = tmp_path / "plain.json", tmp_path / "paged.json"
    import json

    plain.write_text(json.dumps(items, indent=1, ensure_ascii=False))
    paged.write_text(json.dumps([{"da{ta": "{\"", "data": items[:150]}, {"data": []}, {"meta": {"n": 1}, "data": items[150:]}]))
    schema = "id int, name string, sub struct<x: string, y: array<struct<z: string>>>"
    want = sorted((i["id"], i["name"], i["sub"]["x"], i["sub"]["y"][0]["z"]) for i in items)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
        spark.conf.set("spark.sql.files.openCostInBytes", "512")
        assert spark.read.option("lineSep", "}").text(str(plain)).rdd.getNumPartitions() > 8
        for path, depth in ((plain, 1), (paged, 2)):
            rows = readers.read_json_records(spark, str(path), schema, depth).where("id is not null").collect()
            assert sorted((r.id, r.name, r["sub"].x, r["sub"].y[0].z) for r in rows) == want
        (tmp_path / "none.json").write_text("[]\n")
        assert readers.read_json_records(spark, str(tmp_path / "none.json"), schema).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_many_files_are_listed_and_not_opened(spark, tmp_path):
    from vinculo.sources import readers

    (tmp_path / "d" / "e").mkdir(parents=True)
    for i in range(3000):
        (tmp_path / "d" / ("e" if i % 2 else ".") / f"f{i}.csv").write_bytes(b"x" * (i % 5))
    (tmp_path / "d" / "f7.csv").unlink(missing_ok=True)
    (tmp_path / "d" / "e" / "f7.csv").chmod(0)
    got = {r.name: (r.size_bytes, r.found, r.expected) for r in readers.check_sources(spark, str(tmp_path / "d"), ["f7.csv", "none.csv"]).collect()}
    assert len(got) == 3001 and got["f7.csv"] == (2, True, True) and got["none.csv"] == (None, False, True) and got["f4.csv"] == (4, True, False)
    assert readers.list_files(spark, str(tmp_path / "absent")).count() == 0


def test_stored_hops_are_joined_without_a_shuffle(spark, tmp_path):
    loans = spark.createDataFrame([("L1", "b", "VENCIDO", 5.0, 40), ("L2", "c", "VENCIDO", 7.0, 50), ("L3", "a", "ACTIVO", 1.0, 0)], "id_prestamo string, id_titular string, estatus string, saldo_vigente_mxn double, dias_mora int")
    gar = spark.createDataFrame([("G1", "a", "L1"), ("G2", "b", "L2"), ("G3", "b", "L2"), ("G4", "c", "L3"), ("G5", None, "L3")], "id_garantia string, id_garante string, id_prestamo string")
    sinks.store_hops(graph.hops_with_loans(gar, loans), "t_hops", str(tmp_path), 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for stored, plain in ((graph.stored_chain(spark, "t_hops"), graph.guarantee_chain(gar, loans)), (graph.stored_adjacency(spark, "t_hops"), graph.guarantee_adjacency(gar, loans))):
            assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, plain.collect())) and stored.count() > 0
            assert "Exchange" not in stored._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE t_hops_by_src")
        spark.sql("DROP TABLE t_hops_by_dst")


def test_importances_and_lookup(spark):
    rng = random.Random(5)
    rows = [(x := rng.random(), rng.random(), int(x > 0.5)) for _ in range(120)]
    df = spark.createDataFrame(rows, "a double, b double, label int")
    got = scoring.importances(scoring.fit_gbt(df, ["a", "b"], trees=2, depth=2), ["a", "b"], spark).collect()
    assert got[0].feature == "a" and got[0].importance > 0.9 and sum(r.importance for r in got) == pytest.approx(1)
    names = spark.createDataFrame([("x", "Equis")], "id string, name string")
    some = spark.createDataFrame([("x",), ("y",), (None,)], "ref string")
    assert {(r.ref, r.name) for r in acquisition.lookup(some, names, "ref", "unknown").collect()} == {("x", "Equis"), ("y", "unknown"), (None, "unknown")}
