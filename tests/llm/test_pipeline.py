"""Each stage of the pipeline on its own input, and the columns it must return."""

import re

import duckdb
import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_leaks, brute_near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs.cache())]
    for name, f in corpus_pipeline.STAGES:
        out.append((name, f(spark, out[-1][1], SF).cache()))
    return out


def test_stages_keep_columns_and_shrink(stages):
    names = [n for n, _ in stages]
    assert names == ["documents", "toxicity", "exact dedup", "near dedup", "decontamination", "sentencepiece"]
    for (_, a), (_, b) in zip(stages[:-2], stages[1:-1], strict=True):
        assert a.columns == b.columns and set(map(tuple, b.collect())) <= set(map(tuple, a.collect()))
    assert stages[-1][1].count() == stages[-2][1].count()


def test_stages_equal_brute_force(stages):
    rows = [[(r.doc_id, r.text) for r in d.collect()] for _, d in stages[:-1]]
    norm = {}
    for i, t in sorted(rows[1]):
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    assert {i for i, _ in rows[2]} == set(norm.values())
    near = brute_near(rows[2], 5, 80)
    assert {i for i, _ in rows[3]} == {i for i, (_, c) in near.items() if i == c}
    items = duckdb.sql(f"SELECT item_id, text FROM read_parquet('{SF}/benchmark.parquet')").fetchall()
    assert {i for i, _ in rows[4]} == {i for i, _ in rows[3]} - {i for i, _ in brute_leaks(rows[3], items)}


def test_run_equals_the_stages(spark, stages):
    assert {(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect()} == {(r.doc_id, tuple(r.ids)) for r in stages[-1][1].collect()}
