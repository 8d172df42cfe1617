"""Every registered query against its SQL on the small tables."""

import pytest
from compare import compare, duck

from citemill.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
# Queries whose right result is no row; all others must return some.
EMPTY = {"hybrid_filter_empty", "stale_ids"}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    rows, difference = compare(spark, con, name, FOLDER)
    assert difference == ""
    assert (rows == 0) == (name in EMPTY)
