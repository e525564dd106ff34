"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest
from tracewell.plans.queries import oracle_sql, queries


@pytest.fixture(scope="module")
def tables(sf_small):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_small}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def shown(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(shown, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, tables, sf_small, name):
    df = queries()[name](spark, sf_small)
    columns = sorted(df.columns)
    found = tables.execute(oracle_sql()[name])
    given = [d[0] for d in found.description]
    assert sorted(given) == columns
    at = [given.index(c) for c in columns]
    want = sorted((tuple(shown(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert sorted((shown(tuple(r)) for r in df.select(*columns).collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_rows_only(spark, sf_small, name):
    assert queries()[name](spark, sf_small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["license_expression", "kind", "matches", "documents"]
    assert set(queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
