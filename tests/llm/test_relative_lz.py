import random

import numpy as np
import pytest

from quire.llm import relative_lz as R


def records(seed, n=14):
    rnd = random.Random(seed)
    text = lambda k: "".join(rnd.choice("abcé🙂") for _ in range(k))
    passages = [text(k) for k in (11, 12, 13, 40)] + ["ab" * 15]
    return [(rnd.randint(0, 9), text(rnd.randint(0, 25)) + rnd.choice(passages) + text(rnd.randint(0, 9)) + rnd.choice(["", rnd.choice(passages)])) for _ in range(n)] + [(20, ""), (21, "a")]


def test_suffix_order():
    rnd = random.Random(1)
    text = "".join(rnd.choice("ab") for _ in range(400))
    order = R.suffix_order(np.array([ord(c) for c in text]), depth=400).tolist()
    assert order == sorted(range(400), key=lambda i: text[i:])


@pytest.mark.parametrize("seed", range(12))
def test_shared_spans_are_those_of_all_windows(seed):
    rows, length = records(seed), 12
    block = R.Block(rows)
    found = {(i, j, s, e) for i, j, s, e in block.shared(length)}
    for i, j, s, e in found:
        assert rows[i][0] != rows[j][0] and e - s >= length and rows[i][1][s:e] in rows[j][1]
    covered = {(i, j, x) for i, j, s, e in found for x in range(s, e)}
    want = {(i, j, x) for i, (k, t) in enumerate(rows) for j, (m, u) in enumerate(rows) if k != m for s in range(len(t) - length + 1) if t[s : s + length] in u for x in range(s, s + length)}
    assert covered == want


@pytest.mark.parametrize("seed", range(4))
def test_factors_are_greedy(seed):
    """Each factor is the longest string at its place that another record holds, and the factors follow each other."""
    rows = records(seed)
    block = R.Block(rows)
    for i, (key, text) in enumerate(rows):
        at = 0
        for p, n in block.factors(i):
            assert p - block.starts[i] == at
            others = [u for k, u in rows if k != key]
            assert n == max(m for m in range(len(text) - at + 1) if not m or any(text[at : at + m] in u for u in others))
            at += max(1, n)
        assert at == len(text)
