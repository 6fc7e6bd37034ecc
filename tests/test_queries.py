"""Every registered evidence query against its SQL twin at sf0.001."""

from collections import Counter

import duckdb
import pytest

from tablewarden import oracle, queries

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
QUERIES, ORACLE = queries.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    found = QUERIES[name](spark, FOLDER)
    names = sorted(found.columns)
    twin = duck.sql(ORACLE[name])
    assert sorted(twin.columns) == names
    rows = twin.select(*[f'"{c}"' for c in names]).fetchall()
    assert Counter(tuple(map(plain, r)) for r in found.select(*names).collect()) == Counter(tuple(map(plain, r)) for r in rows)
