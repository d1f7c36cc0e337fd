"""Every registered query against its SQL, on the whole tables."""

import os
import sys

import pytest

import oracle

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry_module  # noqa: E402

from workload.registry import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = oracle.connect(sf_dir)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    rows, problems = oracle.compare(duck, QUERIES[name](spark, sf_dir), ORACLES[name])
    assert not problems
    assert rows > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_no_python_workers_and_no_cross_joins(spark, sf_dir):
    """Plans stay on the JVM; only one-row sides are joined without a key."""
    for name, query in QUERIES.items():
        if name.startswith("scan_stream"):
            continue
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        for word in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "Cartesian"):
            assert word not in plan, (name, word)
        if name not in ("page_stop", "limit_repos_page", "sort_repos"):
            assert "NestedLoop" not in plan, name
