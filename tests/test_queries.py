"""Every registered query against its SQL counterpart on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from check_oracles import digest
from passages.plans.table_oracles import ORACLES
from passages.plans.table_queries import QUERIES

FOLDER = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS FROM '{path}'")
    return connection


def test_every_query_has_a_counterpart():
    assert QUERIES.keys() == ORACLES.keys()
    assert contract.oracle_sql().keys() <= contract.queries().keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, database, name):
    actual = contract.queries()[name](spark, str(FOLDER)).toPandas()
    expected = database.sql(contract.oracle_sql()[name]).df()
    assert sorted(actual.columns) == sorted(expected.columns)
    assert digest(actual) == digest(expected)


def test_entry(spark):
    assert contract.entry(spark).count() == 40
