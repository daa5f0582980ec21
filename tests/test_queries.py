"""Every registered query against its SQL on the smallest data."""

import os

import pytest

import __spark_entry__ as entry
from tests.check import ROOT, compare, connect

SF = f"{ROOT}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(name, spark, con):
    problem, n, _ = compare(con, spark, entry.queries()[name], SQL.get(name), SF)
    assert problem is None, problem
    assert n > 0
