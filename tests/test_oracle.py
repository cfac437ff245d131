"""Every registered query against its DuckDB oracle on the smallest test tables."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from costlens.suite.check import compare, duck
from costlens.suite.oracle import all_oracle_sql
from costlens.suite.queries import all_queries

QUERIES = all_queries()
SQL = all_oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_oracle_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    info = compare(spark, con, name, QUERIES[name], SQL[name], SF_SMALL)
    assert info["ok"], info


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["name", "job_id", "workspace_id", "runs", "run_as", "list_cost", "effective_cost",
                          "custom_tags", "last_seen_date"]
