"""The operators' SQL on the driver's smallest tables."""

import os

import pytest

pytest.importorskip("textloom.llm")
duckdb = pytest.importorskip("duckdb")

from textloom.llm import queries  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLES)
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SMALL}/{f}')")
    df = queries.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    found = con.execute(queries.ORACLES[name])
    at = {d[0]: i for i, d in enumerate(found.description)}
    assert sorted(at) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[at[c]] for c in columns) for r in found.fetchall()), key=repr)
