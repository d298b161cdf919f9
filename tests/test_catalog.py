"""Every query against its SQL on the small tables."""

import glob
import os

import duckdb
import pytest

import frostline.queries  # noqa: F401
from frostline.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(value):
    if value is None or isinstance(value, (str, bool)):
        return str(value)
    try:
        return f"{float(value):.9g}"
    except (TypeError, ValueError):
        return str(value)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        connection.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{source}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, db, name):
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    relation = db.sql(ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    want = sorted(tuple(plain(row[i]) for i in at) for row in relation.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in found.collect()) == want
