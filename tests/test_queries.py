"""Every query of the core runs on the smallest tables; those with SQL give the same rows as it does."""

import glob
import os
from decimal import Decimal

import pytest

from tallyloom.plans import catalogue


def canon(value):
    if value is None or value != value:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, Decimal)):
        return f"{float(value):.8g}"
    return str(value)


@pytest.fixture(scope="module")
def sql(small_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{small_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small_dir, sql, name):
    got = catalogue.QUERIES[name](spark, small_dir)
    rows = got.collect()
    if name not in catalogue.SQL:
        return
    want = sql.sql(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    mine = sorted(tuple(canon(r[c]) for c in order) for r in rows)
    theirs = sorted(tuple(canon(r[want.columns.index(c)]) for c in order) for r in want.fetchall())
    assert mine == theirs


def test_the_entry_names_every_query():
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(catalogue.SQL) <= set(__spark_entry__.oracle_sql())
    assert catalogue.FLAGSHIP in catalogue.QUERIES
