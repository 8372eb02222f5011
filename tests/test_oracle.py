"""Every registered query against its SQL on the smallest fixture."""

import pytest

import __spark_entry__ as contract
from tests.conftest import SMALL
from verification.compare import difference, duckdb_on
from verification.oracle import oracle_queries

SQL = oracle_queries()
QUERIES = contract.merchant_queries()


@pytest.fixture(scope="module")
def con():
    return duckdb_on(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(SQL) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("key", list(QUERIES))
def test_query_equals_sql(spark, con, key):
    assert difference(QUERIES[key](spark, SMALL), con, SQL[key]) is None


def test_queries_without_the_optional_subpackage(monkeypatch):
    find = contract.find_spec
    monkeypatch.setattr(contract, "find_spec", lambda name: None if name.startswith("merchlife.llm") else find(name))
    assert set(contract.queries()) == set(QUERIES)
    assert contract.oracle_sql() == SQL


def test_entry_has_rows(spark):
    df = contract.entry(spark)
    assert df.count() == 36
    assert df.columns[0] == "mes"
