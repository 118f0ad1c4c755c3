import random

import pytest

from quire.llm import spans

SCHEMA = "key bigint, body string, foot string, a int, s int"
L, G = 24, 8


def brute(rows):
    """Pairs and shared code points by all windows."""
    where = {}
    for key, *fields in rows:
        for f, t in enumerate(fields):
            for i in range(len(t or "") - L + 1):
                where.setdefault(t[i : i + L], set()).add((key, f, i))
    pairs, covered = set(), {}
    for places in where.values():
        keys = sorted({k for k, _, _ in places})
        if len(keys) > 1:
            pairs |= {(x, y) for n, x in enumerate(keys) for y in keys[n + 1 :]}
            for k, f, i in places:
                covered.setdefault(k, set()).update((f, j) for j in range(i, i + L))
    return pairs, {k: len(v) for k, v in covered.items()}


def corpus(seed):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("abcdeféبَ🙂 ") for _ in range(n))
    passages = [text(n) for n in (L - 1, L, L + 1, 60, 200)] + ["aa" * 40]
    rows = []
    for i in range(120):
        body = text(rnd.randint(0, 150))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            p = rnd.choice(passages)
            cut = rnd.randint(0, len(p) // 3)
            body += p[cut:] + text(rnd.randint(0, 40))
        rows.append((i, body if rnd.random() > 0.1 else None, rnd.choice([None, "", text(30), passages[3]])))
    return rows + [rows[5]] + [(500, "x" * 5000, None), (501, "x" * 300, None)]


@pytest.mark.parametrize(("seed", "group_max", "direct", "chars"), [(1, 2000, 24, 1 << 20), (2, 2000, 3, 100), (3, 4, 24, 30), (4, 2, 2, 1 << 20)])
def test_against_brute_force(spark, seed, group_max, direct, chars):
    rows = corpus(seed)
    pairs, amount = brute([r for r in rows])
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(3)
    assert {tuple(r) for r in spans.shared_pairs(df, "key", ["body", "foot"], L, G, group_max, direct, chars).collect()} == pairs
    assert {r.key: r.shared_chars for r in spans.shared_amount(df, "key", ["body", "foot"], L, G, group_max, direct, chars).collect()} == amount


def test_exact_length_and_fields(spark):
    p = "".join(chr(0x4E00 + i) for i in range(120))
    rows = [(1, "a" + p + "b", None), (2, None, "c" + p + "d"), (3, p[:-1] + "z", None), (4, p[1:], None), (5, "q" * 119, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    assert {tuple(r) for r in spans.shared_pairs(df, "key", ["body", "foot"]).collect()} == {(1, 2)}


def test_nulls_repeats_empty(spark):
    t = "".join(chr(0x4E00 + i) for i in range(300))
    df = spark.createDataFrame([(1, t, None, 1, 2), (1, t, None, 1, 2), (None, t, None, 1, 2), (2, t + t, t, 1, 2)], SCHEMA)
    assert {tuple(r) for r in spans.shared_pairs(df, "key", ["body", "foot"]).collect()} == {(1, 2)}
    assert {r.key: (r.shared_chars, r.n_spans) for r in spans.shared_amount(df, "key", ["body", "foot"]).collect()} == {1: (300, 1), 2: (900, 2)}
    assert spans.shared_pairs(df.limit(0), "key", ["body", "foot"]).count() == 0
