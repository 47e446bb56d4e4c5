"""Every query against its SQL twin on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
from lociweave.queries import ORACLES, QUERIES  # noqa: E402

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(D):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float) and v.is_integer():
        return int(v)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return [cols[k] for k in order], sorted(repr(tuple(plain(r[k]) for k in order)) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, D)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        assert got[1]
        return
    want = con.sql(ORACLES[name])
    assert got == rows(want.columns, want.fetchall())
