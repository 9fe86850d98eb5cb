"""Every registered query against its check SQL on the smallest tables."""

import os

import pytest
from checker import compare, connect

from evenkeel.queries import all_queries

SF = os.environ.get("EVENKEEL_SF", "/root/testdata/sf0.001")
QUERIES, ORACLES = all_queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_check_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
