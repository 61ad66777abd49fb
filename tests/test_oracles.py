"""Every registered query against its SQL on DuckDB."""

import os

import pytest

import __spark_entry__ as contract
from tests.compare import duck, duck_rows, spark_rows

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = contract.oracle_sql()
QUERIES = {name: query for plan in contract._PLANS for name, query in plan.QUERIES.items()}


DUCK_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(ORACLES)
    assert set(ORACLES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    names, expected = duck_rows(con, ORACLES[name])
    assert sorted(df.columns) == names
    described = con.execute(f"DESCRIBE {ORACLES[name]}").fetchall()
    assert {c: DUCK_TYPES[t] for c, t in df.dtypes} == {row[0]: row[1] for row in described}
    got = spark_rows(df)
    assert len(got) == len(expected) > 0
    assert got == expected


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["max_10", "BIN", "portfolio_id", "site_id"]
    assert df.count() > 0
