"""Queries of the training-data operators against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import pytest

from helixplan.llm import registry

DATA = "/root/testdata/sf0.001"


def plain(v):
    return f"{v:.10g}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = registry.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    cursor = con.execute(registry.ORACLES[name])
    order = [[d[0] for d in cursor.description].index(c) for c in names]
    assert len(cursor.description) == len(names)
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
