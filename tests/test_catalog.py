"""Every registered query against its DuckDB counterpart, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from splitboard.plans.catalog import ORACLES, QUERIES
from splitboard.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def _plain(value):
    return f"{value:.6f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(_plain, r)) for r in df.select(*cols).collect())
    if name in ORACLES:
        want = con.sql(ORACLES[name])
        at = [want.columns.index(c) for c in cols]
        assert sorted(want.columns) == cols
        assert got == sorted(tuple(_plain(r[i]) for i in at) for r in want.fetchall())
