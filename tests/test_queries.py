"""Every registered query against its SQL, on the smallest scale."""

import pytest

import __spark_entry__ as contract
from strataforge.plans import catalog
from tools.check import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    ok, text = compare(spark, con, FOLDER, name, QUERIES[name], ORACLES.get(name))
    assert ok, text


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_only_listed_queries_have_no_sql():
    assert sorted(set(catalog.QUERIES) - set(catalog.ORACLES)) == ["S11_sample_files"]
