"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as contract

DATA = Path("/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def plain(frame):
    def text(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    ordered = frame[sorted(frame.columns)]
    return sorted(tuple(text(v) for v in r) for r in ordered.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    got = contract.queries()[name](spark, str(DATA)).toPandas()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
