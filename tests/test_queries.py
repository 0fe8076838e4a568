"""Every registered query against its SQL on the smallest tables."""

import datetime

import duckdb
import pytest

from flowmill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    c = duck.execute(sql)
    columns = [d[0] for d in c.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, c.fetchall())
