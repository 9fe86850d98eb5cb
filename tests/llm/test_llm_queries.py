"""Every registered corpus query on the smallest tables, against its check SQL where it has one."""

import os

import pytest
from checker import compare, connect

from evenkeel.llm import queries as llm

SF = os.environ.get("EVENKEEL_SF", "/root/testdata/sf0.001")
ORACLES = llm.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_check_sql(spark, con, name):
    assert compare(spark, con, name, llm.queries()[name], ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(ORACLES)))
def test_runs(spark, name):
    df = llm.queries()[name](spark, SF)
    assert df.count() >= 50


def test_there_is_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries()) == list(range(1, 14))
