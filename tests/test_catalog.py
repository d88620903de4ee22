"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from linkspark.plans.catalog import CATALOG

SMALL = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return round(float(v), 9) if isinstance(v, float | int) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {f.stem} as from '{f}'")
    return con


@pytest.mark.parametrize("name", list(CATALOG))
def test_query(name, spark, duck):
    query, sql = CATALOG[name]
    df = query(spark, SMALL)
    rows = df.collect()
    if sql is None:
        assert df.columns
        return
    got = duck.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in df.columns) for r in got.fetchall()), key=str)
    assert sorted((tuple(map(plain, r)) for r in rows), key=str) == want
