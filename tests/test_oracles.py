"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quillmere.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    rows = [tuple(round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df, sql = QUERIES[name](spark, SF), duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(sql.fetchall(), sql.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
