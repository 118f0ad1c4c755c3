"""Every core query that has SQL gives the SQL's rows on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from quire.plans import data_queries, reference_queries

PLANS = data_queries.QUERIES | reference_queries.QUERIES
SQL = data_queries.ORACLE | reference_queries.ORACLE


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(spark, sf_dir, duck, name):
    df = PLANS[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in columns) for r in df.collect())
    if name not in SQL:
        return
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = Counter(tuple(norm(dict(zip(names, r))[c]) for c in columns) for r in cursor.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
