"""Registered queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

from pathlib import Path

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
from conftest_llm import corpus, frame

from roundcast.llm.queries import ORACLE, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="benchmark tables are not here")


def plain(table):
    def text(v):
        return "null" if pd.isna(v) else str(int(v)) if isinstance(v, (float, np.floating)) and v == int(v) else str(v)

    return sorted(tuple(text(v) for v in r) for r in table[sorted(table.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), con.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_every_row_has_a_result(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = QUERIES[name](spark, str(DATA))
    assert {r.doc_id for r in got.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(DATA))
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        assert 0 < after.count() <= docs.count()
        docs = after.persist()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA))
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}


def test_stages_with_odd_rows(spark):
    for rows in (corpus(4, 20), []):
        docs = frame(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, str(DATA))
            assert after.columns == docs.columns
            assert after.count() <= docs.count()
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA)).count() > 0) == bool(rows)
