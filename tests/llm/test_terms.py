import os
from collections import Counter

import duckdb
import pytest

from quire.llm import queries, terms


def plain(values):
    occ, rec = Counter(), Counter()
    for v in values:
        if v is None:
            continue
        t = [x for x in (v if isinstance(v, list) else v.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ")) if x]
        occ.update(t)
        rec.update(set(t))
    return {t: (occ[t], rec[t]) for t in occ}


def counts(spark, values, kind):
    df = spark.createDataFrame([(v, 1) for v in values], f"term {kind}, n_records int")
    return {r.term: (r.n_occurrences, r.n_records) for r in terms.term_counts(df, "term").collect()}


def test_texts(spark):
    values = ["a b a", "a\tb\r\nc", None, "", "  ", "a b", "a b a", "ḉ " * 5000]
    assert counts(spark, values, "string") == plain(values)


def test_lists(spark):
    values = [["a", "b", "a", "", None], [], None, ["a"], ["a"]]
    assert counts(spark, values, "array<string>") == plain(values)


def test_spilled_pieces(spark, monkeypatch):
    import pyarrow as pa
    from pyarrow import fs

    rows = [(f"t{i % 997}", i % 3 + 1, 1) for i in range(20_000)] + [("hot", 1, 1)] * 9000
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[i : i + 1000]]), pa.array([r[1] for r in rows[i : i + 1000]], pa.int64()), pa.array([r[2] for r in rows[i : i + 1000]], pa.int64())], schema=terms._COUNTS) for i in range(0, len(rows), 1000)]
    monkeypatch.setattr(terms, "PIECE_ROWS", 1500)
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        got = [x for b in terms._radix(iter(batches), 0, fs.LocalFileSystem(), d) for x in zip(*b.to_pydict().values())]
        left = [f for _, _, fs in os.walk(d) for f in fs if f.endswith(".arrows")]
    want = Counter(), Counter()
    for t, o, r in rows:
        want[0][t] += o
        want[1][t] += r
    assert len(got) == len({g[0] for g in got}) and {t: (o, r) for t, o, r in got} == {t: (want[0][t], want[1][t]) for t in want[0]}
    assert left == []


def test_common_term_of_many_tasks_is_not_split(monkeypatch, tmp_path):
    """Rows of few terms shrink when they are aggregated; pieces of many terms are split at every depth, by rows or by bytes."""
    import pyarrow as pa
    from pyarrow import fs

    def batch(words):
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array([1] * len(words), pa.int64()), pa.array([1] * len(words), pa.int64())], schema=terms._COUNTS)

    splits = []
    monkeypatch.setattr(terms.uuid, "uuid4", lambda real=terms.uuid.uuid4: splits.append(1) or real())
    monkeypatch.setattr(terms, "PIECE_ROWS", 100)
    out = list(terms._radix(iter([batch(["a", "b"] * 40)] * 50), 0, fs.LocalFileSystem(), str(tmp_path)))
    assert not splits and sorted(zip(*pa.Table.from_batches(out).to_pydict().values())) == [("a", 2000, 2000), ("b", 2000, 2000)]
    words = [f"{i}" for i in range(5000)]
    out = pa.Table.from_batches(list(terms._radix(iter([batch(words[i : i + 50]) for i in range(0, 5000, 50)]), 0, fs.LocalFileSystem(), str(tmp_path))))
    assert len(splits) >= 1 + 16 and sorted(out.column(0).to_pylist()) == sorted(words)
    splits.clear()
    monkeypatch.setattr(terms, "PIECE_ROWS", 1 << 40)
    monkeypatch.setattr(terms, "PIECE_BYTES", 10_000)
    out = pa.Table.from_batches(list(terms._radix(iter([batch([w * 100 for w in words[i : i + 10]]) for i in range(0, 500, 10)]), 0, fs.LocalFileSystem(), str(tmp_path))))
    assert splits and out.num_rows == 500


def test_marks(spark):
    df = spark.createDataFrame([("x y",)] * 4 + [("x z",)] * 2 + [(None,)] * 20, "b string")
    got = {r.term: r.mark for r in terms.marked_terms(df, "b").collect()}
    assert got == {"x": "common", "y": "common", "z": "rare"}
    tiny = spark.createDataFrame([("a",)], "b string")
    assert terms.marked_terms(tiny, "b").first().mark == "rare"


def test_empty(spark):
    assert terms.marked_terms(spark.createDataFrame([], "b string"), "b").count() == 0


@pytest.mark.parametrize("name", ["p4_found", "p4_terms"])
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("search_run", "page_text"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    assert Counter(map(tuple, df.collect())) == Counter(con.execute(queries.ORACLE[name]).fetchall())
