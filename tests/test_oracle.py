"""Every registered query against its DuckDB oracle (the driver's correctness gate, run locally)."""

from __future__ import annotations

import pytest

from feedsift.catalog import ORACLES, QUERIES, load_all
from tests.conftest import SMALL
from tests.oracle_check import check, duck

load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = check(spark, con, name, QUERIES[name], ORACLES.get(name), SMALL)
    assert res.get("ok") is True, res                        # a query without an oracle fails too


def test_every_query_has_a_docstring():
    missing = [n for n, f in QUERIES.items() if not (f.__doc__ or "").strip()]
    assert not missing


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_pairs_join(spark, name):
    """No query plans a cross product or a nested-loop join (every join is an equi-join)."""
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
