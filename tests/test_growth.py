"""What the steps of graph queries write grows with the graph, not with the graph times its longest path."""

import random

import pytest

from tests.test_graph_and_ranks import brute
from vinculo.functions import strong
from vinculo.operators import scoring
from vinculo.plans import queries
from vinculo.plans.portfolio import Portfolio


@pytest.fixture
def written(monkeypatch):
    """Rows of each table that the steps of ``strong`` write."""
    rows, plain = [], strong.materialize

    def counted(df, *done):
        out = plain(df, *done)
        rows.append(out.count())
        return out

    monkeypatch.setattr(strong, "materialize", counted)
    return rows


def ladder(steps):
    """Both ways between all neighbours of a ladder: one component, the farther end ``steps`` hops away."""
    e = [(f"{a}{i:03d}", f"{a}{i + 1:03d}") for a in "lr" for i in range(steps)] + [(f"l{i:03d}", f"r{i:03d}") for i in range(steps + 1)]
    return e + [(b, a) for a, b in e]


def test_a_long_component_is_written_a_few_times(spark, written):
    edges = ladder(40)
    got = strong.strong_components(spark.createDataFrame(edges, "src string, dst string")).collect()
    assert len(got) == 82 and {r.component for r in got} == {"l000"}
    assert sum(written) <= 12 * len(edges)  # colours were written whole every three hops, each way


def test_reach_beside_above_and_below_the_largest_component(spark):
    """Tails into and out of a ring, a node that skips it, a second ring, and pairs that only touch what lies below."""
    rng = random.Random(5)
    ring = [(f"k{i}", f"k{(i + 1) % 7}") for i in range(7)] + [("k0", "k3"), ("k5", "k2")]
    other = [("m0", "m1"), ("m1", "m0"), ("m0", "m2"), ("m2", "m0"), ("m2", "d1")]
    edges = ring + other + [("u0", "u1"), ("u1", "k0"), ("u1", "s0"), ("s0", "s1"), ("s1", "d2"), ("k4", "d0"), ("d0", "d1"), ("d1", "d2"), ("a0", "d0"), ("a0", "a1"), ("u0", "m0")]
    for extra in ([], [(f"x{rng.randrange(12)}", f"x{rng.randrange(12)}") for _ in range(30)] + [("x3", "k1"), ("d2", "x5")]):
        nodes, _, reach = brute(edges + extra)
        comp = {x: min([x, *[y for y in reach[x] if x in reach[y]]]) for x in nodes}
        got = {r.node: (r.component, r.reached) for r in strong.reach_counts(spark.createDataFrame(edges + extra, "src string, dst string")).collect()}
        assert got == {x: (comp[x], len(reach[x] - {x})) for x in nodes}


def test_models_that_see_the_same_rows_are_fitted_once(spark, monkeypatch):
    """Two conditions over the same borrowers: only the model with graph features is fitted in each."""
    rng, fits = random.Random(2), []
    for name in ("fit_logistic", "fit_gbt"):
        plain = getattr(scoring, name)
        monkeypatch.setattr(scoring, name, lambda train, features, *a, plain=plain, **k: (fits.append((plain.__name__, len(features))), plain(train, features, *a, **k))[1])
    b = spark.createDataFrame([(i, i // 5, rng.random(), rng.random(), rng.random(), rng.random(), rng.random(), int(rng.random() < 0.4)) for i in range(200)],
                              "borrower_id int, group_id int, balance double, leverage double, interest_coverage double, cash_buffer double, stress double, label int")
    e = spark.createDataFrame([(i, (i + 1) % 200) for i in range(200)], "src int, dst int")
    pred = scoring.run_sweep({"x": (b, e), "y": (b, e.where("src % 2 = 0"))}, [1], trees=1).collect()
    assert sorted(fits) == [("fit_gbt", 3), ("fit_gbt", 6), ("fit_gbt", 6), ("fit_logistic", 3)]
    of = {c: sorted((r.model, r.borrower_id, r.p_raw, r.p) for r in pred if r.condition == c) for c in "xy"}
    assert {m for m, *_ in of["x"]} == {"constant", "logistic", "gbt", "gbt_graph"} and len(of["x"]) == len(of["y"])
    assert [r for r in of["x"] if r[0] != "gbt_graph"] == [r for r in of["y"] if r[0] != "gbt_graph"]


def test_the_registered_experiment_is_whole(spark, monkeypatch):
    """Five seeds in both conditions, and 150 trees a model as in the reference (fitted with one here); models of a run are told apart."""
    trees, plain = [], scoring.fit_gbt
    monkeypatch.setattr(scoring, "fit_gbt", lambda train, features, trees=150, of=trees: (of.append((len(features), trees)), plain(train, features, trees=1))[1])
    pred = queries.predictions(Portfolio(spark, "/root/testdata/sf0.001"))
    assert sorted(trees) == [(3, 150)] * 5 + [(6, 150)] * 10
    runs = {(r.condition, r.seed, r.model): r["count"] for r in pred.groupBy("condition", "seed", "model").count().collect()}
    assert len(runs) == 2 * 5 * 4 and len({r[1] for r in runs}) == 5 and all(runs.values())
