"""Every registered query against its SQL counterpart, on the smallest tables.

Floats may differ in the last rounded digit; ``python tests/compare.py`` compares exactly.
"""

import pytest
from compare import compare, database

from headway.catalog import load

SF = "/root/testdata/sf0.001"
QUERIES = load()
SPLIT = [n for n, q in QUERIES.items() if q.module in ("windows",)] + ["ecdf", "describe_cols", "asof_static", "peak_filter", "interp_at"]


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem, _ = compare(spark, con, SF, QUERIES[name], exact=False)
    assert problem is None


@pytest.mark.parametrize("name", SPLIT)
def test_query_with_hot_keys(spark, con, small_groups, name):
    problem, _ = compare(spark, con, SF, QUERIES[name], exact=False)
    assert problem is None
