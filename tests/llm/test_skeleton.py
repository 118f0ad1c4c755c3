import pytest

from quire.llm import skeleton as S

SCHEMA = "tbl string, book_id int, id int, text string, skel string, own string"


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("abc", "ＡＢＣ".lower()),
        ("abc", "ａｂｃ"),
        ("a b", "a b"),
        ("a b", "a b "),
        ("ab", "a​b﻿"),
        ("ab", "‎a­b⁠"),
        ("é", "é"),
        ("بَّ", "بَّ"),
        ("أ", "أ"),
        ("KB", "КΒ"),
        ("aeoi", "аеοі"),
        ("لا", "ﻼ"),
        ("بن", "ﺑن"),
        ("يب", "یب"),
        ("كت", "کت"),
        ("١٩", "۱۹"),
        ("fi", "ﬁ"),
    ],
)
def test_looks_the_same(a, b):
    assert S.skeleton(a) == S.skeleton(b)


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("ب", "بَ"),
        ("أ", "ا"),
        ("ة", "ه"),
        ("ى", "ي"),
        ("بـن", "بن"),
        ("e", "é"),
        ("a", "A"),
        ("a.", "a"),
        ("<b>a", "a"),
        ("a\nb", "a b"),
        ("a\r", "a"),
        ("a  b", "a b"),
        ("٤", "۴"),
        ("1", "١"),
        ("ﷺ", "صلى"),
    ],
)
def test_looks_different(a, b):
    assert S.skeleton(a) != S.skeleton(b)


def test_plain_text_holds_nothing_to_replace():
    table, _ = S._table()
    assert not [c for c in table if S._PLAIN.fullmatch(c)]


def test_farsi_yeh_at_the_end_is_dotless():
    assert S.skeleton("فی") == S.skeleton("فى") != S.skeleton("في")
    assert S.skeleton("فی​َب") == S.skeleton("فيَب")


def test_defined_results_and_idempotence():
    assert S.skeleton(None) is None and S.skeleton("") == S.skeleton("  ​") == ""
    long = "أ​ ａ" * 200_000
    assert S.skeleton(S.skeleton(long)) == S.skeleton(long)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    found = S.digests(df.drop("skel", "own"), ["tbl", "book_id"], "id", "text")
    return {tuple(r) for r in S.lookalike_pairs(found, ["tbl", "book_id"], "id").collect()}, found


def test_pairs_against_brute_force(spark):
    forms = ["ab", "a​b", "ａb", "ab ", "ac", "a c", "a c", "", None, " "]
    rows = [("t", i % 3, i, forms[(i * 7) % len(forms)]) for i in range(60)] + [("u", 1, 5, "ab"), ("t", 0, 0, "ab"), ("t", 0, 0, "a​b")]
    got, _ = run(spark, rows)
    want = set()
    for t, b, i, x in rows:
        for u, c, j, y in rows:
            if x and y and (t, b) == (u, c) and i < j and x != y and S.skeleton(x) == S.skeleton(y):
                want.add((t, b, i, j))
    assert got == want and got


def test_hot_form_costs_no_pairs(spark):
    got, found = run(spark, [("t", 1, i, "same") for i in range(2000)] + [("t", 1, 9000, "sa​me")])
    assert len(got) == 2000
    assert S.lookalike_groups(found, ["tbl", "book_id"]).first().n_records == 2001


def test_empty(spark):
    assert run(spark, [])[0] == set()


def test_look_alikes_of_further_scripts():
    for a, b in ("pρ", "yү", "vѵ", "QԚ", "WԜ", "gɡ", "GԌ", "oօ", "SՏ", "nո", "hհ", "BᏴ", "oⲟ", "IӀ", "sꜱ", "Dꓓ", "ГΓ", "२૨", "౧೧", "cᴄ"):
        assert S.skeleton(a) == S.skeleton(b), (a, b)
    for a, b in ("lI", "O0", "ıi", "ɑa", "٤۴", "кk"):
        assert S.skeleton(a) != S.skeleton(b), (a, b)


def test_public_list_as_a_parameter(tmp_path):
    """Letters and digits of another script only; one script's own resemblances, signs and ASCII stay apart."""
    path = tmp_path / "list.txt"
    path.write_text("﻿# a list\n2C9F ;\t006F ;\tMA\t# o\n10D8 ; 0069 ; MA # a letter\n0261 ; 0067 ; MA\n0131 ; 0069 ; MA\n2010 ; 002D ; MA\n0031 ; 006C ; MA\n0DEA ; 0DA2 ; MA\n0966 ; 006F ; MA\n\n1D41 ; 0061 0062 ; MA\n", "utf-8")
    assert S.look_alikes(str(path)) == {"ⲟ": "o", "ი": "i", "०": "o"}
    assert S.skeleton("mი०", str(path)) == "mio" and S.skeleton("mი०") != "mio" and S.skeleton("Аⲟ", str(path)) == "Ao"
