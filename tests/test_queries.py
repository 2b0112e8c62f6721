"""Every registered portfolio query with SQL against that SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from vinculo.plans.oracles import ORACLES
from vinculo.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        c.execute(f"CREATE VIEW {t} AS FROM read_parquet('{SF}/{t}.parquet')")
    return c


def norm(rows):
    return sorted((tuple(float(f"{x:.9g}") if isinstance(x, float) and not math.isnan(x) else x for x in r) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(ORACLES[name])
    assert sorted(d[0] for d in want.description) == cols
    at = {d[0]: i for i, d in enumerate(want.description)}
    assert norm(map(tuple, df.select(*cols).collect())) == norm(tuple(r[at[c]] for c in cols) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_unlimited_reach_equals_brute_force(spark):
    """All nodes that paths of any length reach, of which some lie beyond four hops."""
    out, want = {}, set()
    for r in QUERIES["guarantee_adjacency"](spark, SF).select("src", "dst").collect():
        out.setdefault(r.src, set()).add(r.dst)
    for start in out:
        seen, front, depth = {start}, {start}, 0
        while front:
            front, depth = {y for x in front for y in out.get(x, ())} - seen, depth + 1
            want |= {(start, y, depth) for y in front}
            seen |= front
    assert {(r.start, r.node, r.depth) for r in QUERIES["reach_unlimited"](spark, SF).collect()} == want and max(d for _, _, d in want) > 4
