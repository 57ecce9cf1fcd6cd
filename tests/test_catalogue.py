"""Every query with SQL against DuckDB on the driver's smallest tables; the others must run."""

import math
import os

import pytest

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")


def _names():
    from tidemark import catalogue

    return sorted(catalogue.queries())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(D):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{D}/{t}'")
    return con


def _plain(rows):
    clean = lambda v: round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v
    return sorted([tuple(map(clean, r)) for r in rows], key=str)


@pytest.mark.parametrize("name", _names())
def test_query(name, spark, duck):
    from tidemark import catalogue, oracles

    df = catalogue.queries()[name](spark, D)
    columns = sorted(df.columns)
    rows = _plain([tuple(r[c] for c in columns) for r in df.collect()])
    sql = oracles.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql)
        assert sorted(want.columns) == columns
        assert rows == _plain([tuple(dict(zip(want.columns, r))[c] for c in columns) for r in want.fetchall()])
    else:
        assert rows


def test_flagship(spark):
    from tidemark import catalogue

    assert catalogue.flagship(spark, D).count() > 0
