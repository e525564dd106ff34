"""Queries that SQL can express against their SQL, over whole tables."""

import glob
import os

import duckdb
import pytest
from tracewell.llm.queries import oracle_sql, queries

from ..test_queries import shown


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, sf_mid, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_mid}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = queries()[name](spark, sf_mid)
    found = con.execute(oracle_sql()[name])
    given = [d[0] for d in found.description]
    columns = sorted(df.columns)
    assert sorted(given) == columns
    want = sorted((tuple(shown(r[given.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    got = sorted((shown(tuple(r)) for r in df.select(*columns).collect()), key=repr)
    assert len(got) == len(want) and got == want
