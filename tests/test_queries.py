"""Every registered query of the tensor engine against its SQL twin, on the smallest tables."""

import math

import duckdb
import pytest

from blockloom.plans.queries import ORACLES, QUERIES

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(columns).collect()), key=repr)
    made = sql.execute(ORACLES[name])
    order = [d[0] for d in made.description]
    assert sorted(order) == columns
    want = sorted((tuple(plain(r[order.index(c)]) for c in columns) for r in made.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
