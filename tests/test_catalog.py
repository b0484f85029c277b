"""Every catalog query against the same query in SQL, on whole tables."""

from __future__ import annotations

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from tidemark.plans import streamed  # noqa: F401
from tidemark.plans.catalog import QUERIES
from tidemark.plans.oracles import ORACLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{files}'")
    return con


def normal(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, Decimal):
        return str(value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(normal(row[i]) for i in order) for row in rows),
        key=lambda row: tuple((v is None, str(v)) for v in row),
    )


# how each engine names the type of a column
SAME_TYPE = {
    "string": "VARCHAR",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "decimal(38,2)": "DECIMAL(38,2)",
}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    types = {c[0]: str(c[1]) for c in result.description}
    expected = result.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert {f.name: SAME_TYPE[f.dataType.simpleString()] for f in df.schema} == types
    actual = rows_of(df.columns, [tuple(r) for r in df.collect()])
    wanted = rows_of(names, expected)
    assert len(actual) == len(wanted)
    assert wanted, "a query that finds nothing checks nothing"
    assert actual == wanted
