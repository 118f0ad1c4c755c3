import random

import pytest

from quire.operators import forest

SCHEMA = "book_id int, id int, parent int, loaded_at int, path string, grp string, node string"


def resolved(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    return forest.resolve_forest(forest.last_rows(df, "book_id", "id", "parent", "loaded_at"))


def plain(rows):
    """Brute force: follow the parents of the last row of each node."""
    last = {}
    for b, i, p, t in rows:
        if b is not None and i is not None and (t, p if p is not None else -1) >= last.get((b, i), ((-1, -1), 0))[0]:
            last[b, i] = ((t, p if p is not None else -1), p)
    out = {}
    for b, i in last:
        path, at = [i], i
        while True:
            p = last[b, at][1]
            if not p or (b, p) not in last:
                out[b, i] = path[::-1]
                break
            if p in path:
                out[b, i] = None
                break
            path.append(p)
            at = p
    return out


def check(spark, rows):
    got = {(r.grp, r.id): r.path for r in resolved(spark, rows).collect()}
    want = plain(rows)
    assert got == want
    return got


def test_shapes(spark):
    rows = [(1, 1, 0, 0), (1, 2, 1, 0), (1, 3, 2, 0), (1, 4, 99, 0), (1, 5, None, 0), (1, 6, 6, 0), (1, 7, 8, 0), (1, 8, 7, 0), (1, 9, 8, 0), (2, 1, 2, 0), (2, 2, 0, 0)]
    got = check(spark, rows)
    assert got[1, 3] == [1, 2, 3] and got[1, 9] is None and got[1, 4] == [4]


def test_last_row_counts_and_repeats(spark):
    rows = [(1, 1, 0, 0), (1, 2, 1, 0), (1, 2, 1, 0), (1, 1, 2, 5), (1, 3, 2, 1), (1, 3, 0, 4), (1, 3, 2, 4), (None, 1, 0, 0), (1, None, 0, 0)]
    got = check(spark, rows)
    assert got[1, 1] is None and got[1, 2] is None


@pytest.mark.parametrize(("seed", "cell"), [(1, 1 << 15), (2, 4), (3, 1)])
def test_random_graphs(spark, monkeypatch, seed, cell):
    monkeypatch.setattr(forest, "CELL", cell)
    rnd = random.Random(seed)
    rows = []
    for b in range(40):
        n = rnd.choice([1, 3, 20, 60])
        rows += [(b, i, rnd.choice([0, None, rnd.randint(1, n + 2), max(1, i - 1), max(1, i - 1)]), rnd.randint(0, 3)) for i in range(1, n + 1)]
    check(spark, rows)


@pytest.mark.parametrize("cell", [1 << 15, 64])
def test_long_chain_and_long_loop(spark, monkeypatch, cell):
    monkeypatch.setattr(forest, "CELL", cell)
    n = 700
    rows = [(1, i, i - 1, 0) for i in range(1, n)] + [(2, i, i % 300 + 1, 0) for i in range(1, 301)] + [(2, 400, 7, 0)]
    got = check(spark, rows)
    assert len(got[1, n - 1]) == n - 1 and got[2, 400] is None


def test_root_depth_and_descendants(spark):
    r = resolved(spark, [(1, 1, 0, 0), (1, 2, 1, 0), (1, 3, 2, 0), (1, 4, 4, 0)])
    assert {(x.id, x.root, x.depth, x.in_loop) for x in r.collect()} == {(1, 1, 0, False), (2, 1, 1, False), (3, 1, 2, False), (4, None, None, True)}
    assert {(x.ancestor, x.descendant, x.distance) for x in forest.descendants(r).collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1)}


def test_empty(spark):
    assert resolved(spark, []).count() == 0
