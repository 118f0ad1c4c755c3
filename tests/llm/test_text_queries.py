"""The text operators' queries over the smallest tables: those with SQL give its rows."""

import os
from collections import Counter

import duckdb
import pytest

from quire.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    cursor = duck.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    assert got == Counter(tuple(dict(zip(names, r))[c] for c in columns) for r in cursor.fetchall())


def test_shares_meet_the_targets(spark, sf_dir):
    rows = QUERIES["p9_shares"](spark, sf_dir).collect()
    norm, used = sum(r.weight for r in rows if r.n_tokens), sum(r.used_tokens for r in rows)
    assert used > 0 and sum(r.actual for r in rows) == pytest.approx(1)
    for r in rows:
        want = r.weight / norm if r.n_tokens else 0.0
        assert abs(r.actual - want) <= len(rows) * r.longest / used and r.most_copies <= r.max_repeat
