"""Queries that answer every question, not a part of them: none of the smallest tables' ids is a multiple of 100."""

import os

import pytest
from oracle import connect

from loomgraph.plans import graphs, searches

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _asked(df):
    return {r["query_id"] for r in df.select("query_id").distinct().collect()}


@pytest.fixture(scope="module")
def ids():
    if not os.path.isdir(ROOT):
        pytest.skip("no test tables here")
    return {r[0] for r in connect(ROOT).execute("select distinct id from questions").fetchall()}


def test_hybrid_retrieval(spark, ids):
    found = _asked(graphs.hybrid_retrieval(spark, ROOT))
    assert found <= ids and len(found) > 0.9 * len(ids)


def test_passage_rank(spark, ids):
    assert len(_asked(graphs.passage_rank(spark, ROOT)) & ids) > 0.9 * len(ids)


def test_ppr(spark, ids):
    assert len(_asked(graphs.ppr(spark, ROOT)) & ids) > 0.9 * len(ids)


def test_pcst_subgraph(spark, ids):
    assert len(_asked(graphs.pcst_subgraph(spark, ROOT)) & ids) > 0.5 * len(ids)


@pytest.mark.parametrize("method", ["subgraph", "ppr", "global"])
def test_search(spark, ids, method):
    assert _asked(searches.queries()[f"search_{method}"](spark, ROOT)) == ids
