"""Every core query with SQL against DuckDB on the smallest tables."""

import importlib
import os

import pytest
from oracle import compare, connect

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MODULES = [importlib.import_module(f"loomgraph.plans.{m}") for m in ("general", "texts", "graphs", "searches")]
CASES = {n: (m.queries()[n], sql) for m in MODULES for n, sql in m.oracles().items()}


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(ROOT):
        pytest.skip("no test tables here")
    return connect(ROOT)


@pytest.mark.parametrize("name", sorted(CASES))
def test_equal(spark, con, name):
    query, sql = CASES[name]
    assert compare(spark, con, ROOT, name, query, sql) == ""
