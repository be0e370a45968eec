"""Each query against its SQL on the smallest fixture."""

import datetime

import duckdb
import pytest

from auditloom.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    rows = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert df.columns
        return
    r = duck.execute(catalog.ORACLE_SQL[name])
    columns = sorted(c[0] for c in r.description)
    at = [[c[0] for c in r.description].index(c) for c in columns]
    assert columns == sorted(df.columns)
    want = sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
    assert sorted((tuple(plain(x[c]) for c in columns) for x in rows), key=repr) == want
