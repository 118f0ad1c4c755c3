import random

import pytest

from quire.llm import tokens as T

PATH = T.default_vocabulary()
POOLS = ["abc de  \n\n 123's' ll're", "กาบทคี่ ", "明与本者。！", "العلم ـَ", "aaaaab", "  \n\t x", "é́𐐷🙂ﷺ "]


def plain(text):
    return T.encoder(PATH)[0].encode_ordinary(text) if text else []


@pytest.mark.parametrize("part", [1, 2, 7, 50])
def test_tree_equals_whole(part):
    rnd = random.Random(part)
    for _ in range(400):
        pool = rnd.choice(POOLS) + rnd.choice(["", rnd.choice(POOLS)])
        text = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, rnd.choice([5, 40, 600]))))
        assert T.encode_text(text, PATH, part) == plain(text), (text, part)


@pytest.mark.parametrize("text", ["ก" * 20_000, "明与本者" * 5000, "a" * 20_000, " " * 9000, "".join(random.Random(1).choice("abcdefgh") for _ in range(30_000)), "'" * 3000 + "ll" * 3000])
def test_long_unsplit_pieces(text):
    assert T.encode_text(text, PATH, 1024) == plain(text)


@pytest.mark.parametrize("size", [1, 5, 16, 64])
def test_halves_of_unsplit_pieces(size):
    rnd = random.Random(size)
    for _ in range(200):
        pool = rnd.choice(POOLS) + rnd.choice(["", rnd.choice(POOLS)])
        text = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 300)))
        assert T.encode_plain(text, PATH, size) == plain(text), (text, size)
    for piece in ("ก" * 3000, "明与本者" * 700, "ab" * 2500, "🙂" * 500):
        assert T.halved(piece, PATH, size * 16) == plain(piece)


def test_long_texts_in_rounds(spark):
    """A table of long texts, unsplit and not: parts of 64 code points, four of them joined by a task of each of four rounds."""
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(3000, 16_000))) for pool in POOLS] + ["ก" * 16_000, " " * 5000, "a" * 12_345, "ab '" * 4000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in T.encode(df, "doc_id", "text", long=100, part=64, fan=4, rounds=4).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_second_library_agrees():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in ("Hello <|endoftext|> you're", "العلم ٢٣٤", "ग्रन्थ पर।", "\n\n  x"):
        assert t.encode(text, add_special_tokens=False).ids == plain(text)


def test_distributed(spark):
    rnd = random.Random(2)
    rows = [(1, None), (2, ""), (3, " "), (4, "<|endoftext|>"), (5, "short text"), (5, "short text")]
    rows += [(10 + i, "".join(rnd.choice(POOLS[i % 7] + "x") for _ in range(rnd.randint(90, 1500)))) for i in range(30)]
    df = spark.createDataFrame([(*r, [1], "s") for r in rows], "doc_id bigint, text string, ids array<int>, c0 string")
    got = sorted((r.doc_id, r.ids) for r in T.encode(df, "doc_id", "text", long=100, part=64).collect())
    assert got == sorted((i, plain(t)) for i, t in rows)
    assert {r.c0 for r in T.encode(df, "doc_id", "text", carry=("c0",), long=100, part=64).collect()} == {"s"}
    assert T.encode(df.limit(0), "doc_id", "text").count() == 0
