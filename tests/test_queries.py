"""Every engine query against its SQL, on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from scenaria import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, decimal.Decimal):
        return int(x) if x == int(x) else float(x)
    return x


def rows(columns, found):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted([tuple(plain(r[k]) for k in at) for r in found], key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df, sql = queries.queries()[name](spark, DATA), duck.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(df.columns, df.collect()) == rows(sql.columns, sql.fetchall())


def test_entry(spark):
    assert queries.flagship(spark, DATA).count() > 0
