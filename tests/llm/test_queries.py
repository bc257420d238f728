"""Every query of the operators on the smallest tables, with SQL where it can say the same."""

from pathlib import Path

import duckdb
import pytest

from check_oracles import digest
from passages.llm.oracles import ORACLES
from passages.llm.queries import QUERIES

FOLDER = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, name):
    database = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        database.sql(f"CREATE VIEW {path.stem} AS FROM '{path}'")
    actual = QUERIES[name](spark, str(FOLDER)).toPandas()
    expected = database.sql(ORACLES[name]).df()
    assert sorted(actual.columns) == sorted(expected.columns)
    assert digest(actual) == digest(expected)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_rows(spark, name):
    rows = QUERIES[name](spark, str(FOLDER))
    table = {"op2_conversations": "conversations", "op10_extraction": "pages"}.get(name, "documents")
    total = spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    if name in ("op5_leaks", "op9_licences"):
        assert 0 < rows.count() < total
    elif name == "op11_packing":
        assert rows.select("doc_id").distinct().count() == total
    else:
        assert rows.count() == total
