from datetime import datetime

from pyspark.sql import functions as F

from quire.operators.orphans import Reference, Target, orphan_report, orphans

T = [datetime(2024, m, 1) for m in range(1, 13)]
CHILD = "rec bigint, k int, at timestamp_ntz, key string, target string"
PARENT = "k int, at timestamp_ntz, gone timestamp_ntz, tbl string"


def found(spark, children, parents, **options):
    c = spark.createDataFrame([(*r, "x", "y") for r in children], CHILD)
    p = spark.createDataFrame([(*r, "z") for r in parents], PARENT)
    refs = [Reference("c", "k", "p", c, F.col("rec"), [F.col("k")], F.col("at"))]
    return orphans(refs, [Target("p", p, [F.col("k")], F.col("gone").isNull(), F.col("at"))], **options)


def test_absent_withdrawn_and_late(spark):
    children = [(1, 1, T[5]), (2, 2, T[5]), (3, 3, T[5]), (4, 4, T[5]), (5, 4, T[7]), (6, None, T[5])]
    parents = [(1, T[0], None), (2, T[0], T[1]), (4, T[6], None), (4, T[8], None), (None, T[0], None)]
    assert {r.rec_id for r in found(spark, children, parents).collect()} == {2, 3, 4}


def test_same_moment_satisfies_and_second_valid_row_counts(spark):
    assert found(spark, [(1, 1, T[3]), (2, 2, T[3])], [(1, T[3], None), (2, T[0], T[1]), (2, T[2], None)]).count() == 0


def test_null_times(spark):
    got = {r.rec_id for r in found(spark, [(1, 1, None), (2, 2, T[1])], [(1, T[0], None), (2, None, None)]).collect()}
    assert got == {2}


def test_repeats_and_report(spark):
    f = found(spark, [(1, 9, T[0]), (1, 9, T[0]), (2, 9, T[0]), (3, 8, T[1])], [])
    assert {r.rec_id for r in f.collect()} == {1, 2, 3}
    assert {(r.month, r.n_orphans, r.n_keys) for r in orphan_report(f).collect()} == {("2024-01", 2, 1), ("2024-02", 1, 1)}


def test_hot_key(spark):
    got = found(spark, [(i, 7, T[2]) for i in range(3000)] + [(i, i, T[2]) for i in range(5000, 5100)], [(i, T[0], None) for i in range(5000, 5100)])
    assert got.count() == 3000


def test_hot_keys_are_spread_by_their_counts(spark):
    """Of keys with 3000, 400 and single children those over a hundredth of all are spread, the larger the more; no row is lost or doubled."""
    children = [(i, 7, T[2]) for i in range(3000)] + [(4000 + i, 8, T[2 + i % 2 * 6]) for i in range(800)] + [(i, i, T[2]) for i in range(5000, 5100)]
    parents = [(8, T[5], None), (5000, T[0], None)]
    df = found(spark, children, parents, hot=100)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert "salts" in text and "salts" not in found(spark, children[3000:3001], [], hot=1)._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.rec_id for r in df.collect()) == sorted([*range(3000), *range(4000, 4800, 2), *range(5001, 5100)])


def test_empty(spark):
    assert found(spark, [], [(1, T[0], None)]).count() == 0
    assert found(spark, [(1, 1, T[0])], []).count() == 1
