import random

from quire.functions.arabic import fold_query
from quire.operators import postings, search

WORDS = "ا ب ج د".split()


def test_against_direct_search(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 9))), rnd.choice([None, "", "ا ب", "د"])) for i in range(200)] + [(999, None, None)]
    df = spark.createDataFrame(rows, "k int, body string, foot string")
    fields = ["body", "foot"]
    postings.save(postings.postings(df, ["k"], fields), ["k"], f"{tmp_path}/index")
    index = postings.load(spark, f"{tmp_path}/index")
    for q in ("ا", "ا ب", "ج د ج", "ز", " "):
        got = {(r.k, tuple(r.matched_in)) for r in postings.search(index, ["k"], fields, q).collect()}
        want = {(r.k, tuple(r.matched_in)) for r in search.search(df, fields, q).collect()}
        assert got == want
        t = fold_query(q)
        held = lambda text, t=t: any((text or "").split()[i : i + len(t)] == t for i in range(len((text or "").split()))) if t else False
        want = {(k, tuple(f for f, x in zip(fields, (b, g)) if held(x))) for k, b, g in rows if held(b) or held(g)}
        assert {(r.k, tuple(r.matched_in)) for r in postings.phrase(index, ["k"], fields, q).collect()} == want


def test_query_prunes_buckets(spark, tmp_path):
    df = spark.createDataFrame([(1, "ا ب ج د", None)], "k int, body string, foot string")
    postings.save(postings.postings(df, ["k"], ["body"]), ["k"], f"{tmp_path}/index")
    plan = postings.search(postings.load(spark, f"{tmp_path}/index"), ["k"], ["body"], "ا")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(token" in plan
