"""Every registered query against its SQL, on the smallest files."""

import pytest
from compare import compare, duck
from conftest import SF

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_names_agree():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) > 130


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    msg = compare(spark, con, SF, QUERIES[name], SQL[name])
    assert msg is None or msg == "both are empty", msg


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["outcome", "project_type", "requests", "billable"]
    assert df.count() > 0
