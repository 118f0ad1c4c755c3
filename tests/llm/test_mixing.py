import math

import pytest

from quire.llm import mixing as M

DOCS = "doc_id bigint, source string, n_tokens int"


def test_tempered_and_entropy():
    shares = [0.7, 0.2, 0.1, 0.0]
    assert M.tempered(shares, 1.0) == pytest.approx(shares)
    assert M.tempered(shares, 0.0) == pytest.approx([1 / 3, 1 / 3, 1 / 3, 0])
    for target in (0.2, 0.8, 1.05):
        assert M.entropy(M.tempered(shares, M.exponent_for_entropy(shares, target))) == pytest.approx(target, abs=1e-6)


def test_plan_meets_targets_at_the_largest_total():
    s = M.plan([M.Source("a", 0.5, 1, 10, 1000), M.Source("b", 0.3, 4, 5, 100), M.Source("none", 0.2, 3)])
    a, b, none = s
    assert none.budget == 0 and a.target == pytest.approx(0.625) and b.budget == pytest.approx(400) and a.budget == pytest.approx(400 / 0.375 * 0.625)


def test_plan_moves_towards_natural_shares_if_the_total_asks_too_much():
    a, b = M.plan([M.Source("a", 0.5, 1, 10, 1000), M.Source("b", 0.5, 2, 5, 100)], total=900)
    assert a.budget + b.budget == pytest.approx(900) and b.budget == pytest.approx(200, rel=1e-6) and a.budget <= 1000


def run(spark, docs, targets):
    d = spark.createDataFrame(docs, DOCS)
    t = spark.createDataFrame(targets, "source string, weight double, max_repeat int")
    sources = M.plan(M.measure(d, t))
    chosen = M.select(d, sources)
    return [tuple(r) for r in chosen.select("doc_id", "source", "n_tokens", "copies").collect()], {r.source: r for r in M.report(chosen, sources).collect()}


def test_shares_and_caps(spark):
    docs = [(i, "big", i % 50 + 1) for i in range(3000)] + [(10_000 + i, "small", 20) for i in range(40)] + [(20_000, None, 5), (20_001, "small", 0), (20_002, "other", 9)]
    rows, report = run(spark, docs, [("big", 0.7, 1), ("small", 0.2, 3), ("void", 0.1, 2)])
    cap = {"big": 1, "small": 3}
    assert len({r[0] for r in rows}) == len(rows) and all(1 <= c <= cap[s] and n > 0 for _, s, n, c in rows)
    total = sum(n * c for _, _, n, c in rows)
    for s, want in (("big", 7 / 9), ("small", 2 / 9)):
        assert sum(n * c for _, x, n, c in rows if x == s) / total == pytest.approx(want, abs=0.01)
        assert report[s].actual == pytest.approx(report[s].used_tokens / total)
    assert report["void"].actual == 0 and report["void"].n_docs == 0
    assert report["small"].most_copies == 3


def test_partial_pass_is_within_one_document(spark):
    docs = [(i, "a", 7) for i in range(5000)] + [(9000 + i, "b", 3) for i in range(100)]
    _, report = run(spark, docs, [("a", 0.9, 1), ("b", 0.1, 1)])
    assert abs(report["a"].used_tokens - report["a"].budget) <= 7 and report["b"].used_tokens == 300


def test_empty_and_errors(spark):
    rows, report = run(spark, [], [("a", 1.0, 2)])
    assert rows == [] and report["a"].actual == 0
    with pytest.raises(ValueError):
        run(spark, [(1, "a", 1)], [("a", 0.5, 1), ("a", 0.5, 1)])


def test_blended_ends():
    t, s = [0.5, 0.5], [0.9, 0.1]
    assert M.blended(t, s, 0) == pytest.approx(t) and M.blended(t, s, 1) == pytest.approx(s) and math.isclose(sum(M.blended(t, s, 0.3)), 1)


def test_exponent_moves_on_where_the_tempered_shares_ask_too_much():
    """Entropy of even targets: exponent 0; the small source may be used once, so the exponent is bisected towards 1 to its limit."""
    s = [M.Source("a", 0.5, 1, 10, 8000), M.Source("b", 0.3, 1, 10, 1500), M.Source("c", 0.2, 1, 10, 500)]
    a, b, c = M.plan(s, total=4000)
    assert sum(x.budget for x in s) == pytest.approx(4000) and c.budget == pytest.approx(500, rel=1e-6) and b.budget <= 1500 and a.budget <= 8000
    assert M.entropy([x.tempered for x in s]) == pytest.approx(M.entropy([0.5, 0.3, 0.2]), abs=1e-6)
    exact = M.plan([M.Source("a", 0.5, 1, 10, 8000), M.Source("b", 0.3, 1, 10, 1500), M.Source("c", 0.2, 1, 10, 500)])
    assert [x.target for x in exact] == pytest.approx([0.5, 0.3, 0.2]) and sum(x.budget for x in exact) == pytest.approx(2500)


def test_one_pass_and_one_join(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", 5) for i in range(600)], DOCS)
    sources = M.plan(M.measure(docs, spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, weight double, max_repeat int")))
    text = M.select(docs, sources)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("LogicalRDD") + text.count("LocalRelation") <= 4 and "CartesianProduct" not in text
