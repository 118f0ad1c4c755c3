import random

import pytest
from pyspark.sql import functions as F

from quire.functions import arabic as A
from quire.functions import verses
from quire.functions.snippets import exact_snippet, snippet, split_parts


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_index_fold(spark):
    words = "الأُصُولِ ابن إبن فتوى مؤمن صلاة كتـاب الرَّحْمَٰن شيء مسائل گاه".split()
    want = "الاصول بن بن فتوي مومن صلاه كتاب الرحمن شيء مسائل كاه".split()
    assert [A.fold_token(w) for w in words] == want
    assert column(spark, words, lambda c: A.index_tokens(c)[0]) == want


def test_verify_fold(spark):
    assert column(spark, ["شيء", "مسائل", "گاه", None, "أَ"], A.verify_fold) == ["شي", "مسايل", "گاه", None, "ا"]


def test_tokenizer(spark):
    text = "قال ابن عثيمين: الكلام، لغةً <b>هو</b> اللفظ 12 ٣٤"
    want = ["قال", "بن", "عثيمين", "الكلام،", "لغه", "هو", "اللفظ", "٣٤"]
    assert A.query_tokens(text) == want
    assert column(spark, [text, None, ""], A.verify_tokens) == [want, [], []]


def test_query_terms_have_no_cap():
    assert A.fold_query("إنما الأعمال بالنيات وإنما لكل امرئ ما نوى") == ["انما", "الاعمال", "بالنيات", "وانما", "لكل", "امرئ", "ما", "نوي"]
    assert A.fold_query(None) == A.fold_query("  ") == []


def test_variants():
    want = "الصبر والصبر فالصبر بالصبر كالصبر صبر وصبر فصبر بصبر كصبر لصبر للصبر".split()
    assert sorted(A.prefix_variants("الصبر")) == sorted(want)
    assert A.prefix_variants("ق") == ["ق"]


def test_exact_flags(spark):
    text = "إلَى ٱلْكِتـَـابِ ٣ <i>ب</i>\n د"
    for i in range(8):
        flags = {"diacritics": bool(i & 4), "hamza": bool(i & 2), "digits": bool(i & 1)}
        assert column(spark, [text], lambda c, flags=flags: A.exact_fold(c, **flags)) == [A.fold_exact(text, **flags)]
    assert A.fold_exact(text) == "الي الكتاب 3 ب د"
    assert "ٱ" in A.fold_exact(text, hamza=True) and "٣" in A.fold_exact(text, digits=True)


def test_labels_years_digits(spark):
    rows = [("3", 512), (None, 22), ("الكتاب", 7), ("3", None), (None, None), (" ", 5)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, part string, page int")
    got = [r.x for r in df.select("i", A.printed_label(F.col("part"), F.col("page")).alias("x")).orderBy("i").collect()]
    assert got == ["3/ 512", "22", "7", None, None, "5"]
    years = spark.createDataFrame([(1,), (100,), (101,), (1421,), (None,), (0,), (99999,)], "y int")
    got = [(r.c, r.k) for r in years.select(A.century(F.col("y")).alias("c"), A.known_year(F.col("y")).alias("k")).collect()]
    assert [c for c, _ in got][:5] == [1, 1, 2, 15, None] and [k for _, k in got][4:] == [None, None, None]
    assert column(spark, ["ج 12", None], A.arabize) == ["ج ١٢", ""]


def test_stems(spark):
    words = ["والكتاب", "كتابها", "مسلمون", "ال", "استفزاط", "ولد", "بالعلمين", ""]
    got = column(spark, words, A.light_stem)
    assert got[:4] == ["كتاب", "كتاب", "مسلم", "ال"] and got == [A.stem_of(w) for w in words] and all(g in w for g, w in zip(got, words))


def test_globs():
    import re

    assert re.match(A.glob_pattern("ص?م*"), "صومعة") and not re.match(A.glob_pattern("a.b?"), "axbc")


def test_verse_numbers():
    assert verses.TOTAL == 6236 and len(verses.NAMES) == len(verses.VERSES) == 114
    for (s, v), n in {(1, 1): 1, (1, 7): 7, (2, 1): 8, (114, 6): 6236, (2, 255): 262}.items():
        assert verses.aya_id(s, v) == n and verses.sura_and_verse(n) == (s, v)
    assert verses.aya_id(1, 8) is None and verses.aya_id(0, 1) is None and verses.sura_and_verse(6237) is None and verses.sura_and_verse(0) is None


def test_aya_dim(spark):
    rows = verses.aya_dim(spark).collect()
    assert len(rows) == 6236 and all(verses.sura_and_verse(r.aya_id) == (r.surah, r.aya) for r in rows[::97])


def test_snippet():
    text = "ا" * 200 + " الأُصُولُ " + "ب" * 200
    s = snippet(text, ["الاصول"])
    assert s.startswith("…") and s.endswith("…") and "<mark>الأُصُولُ</mark>" in s
    assert snippet("<b>هذا</b> كتاب هذا", ["هذا"]) == "<mark>هذا</mark> كتاب <mark>هذا</mark>"
    assert snippet(None, ["x"]) == snippet("", ["x"]) == snippet("abc", []) == snippet("abc", ["x"]) == ""


def test_exact_snippet():
    text = "و" * 150 + " إلَى ما " + "ي" * 150
    s = exact_snippet(text, A.fold_exact("إلى ما", hamza=True), hamza=True)
    assert s.startswith("… ") and s.endswith(" …") and "إلَى ما" in s
    assert exact_snippet(None, "x") == "" and exact_snippet("a" * 300, "x") == "a" * 180 + " …"


@pytest.mark.parametrize("seed", range(5))
def test_parts_cover_the_text(seed):
    rnd = random.Random(seed)
    text = "".join(rnd.choice(["abc ", "d", "\n", "\n\n", " e "]) for _ in range(400))
    parts = split_parts(text, 50)
    assert all(len(p) <= 52 for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())
    assert split_parts("", 50) == [""] and split_parts("abc", 0) == ["abc"]


def test_whole_tokens_behind_any_number_of_marks(spark):
    """A word at the end of a longer token is none, however many dropped marks stand between; marks alone before it are."""
    rows = ["ب" + "ـ" * n + "هذا" for n in (0, 1, 65, 300)] + ["ـ" * 300 + "هذا", ".َهذا", "هذا", "هذا" + "ـ" * 99 + "ن"]
    assert column(spark, rows, lambda c: c.rlike(A.index_pattern("هذا"))) == [False] * 4 + [True] * 3 + [False]
    assert column(spark, rows, lambda c: c.rlike(A.verify_pattern(["هذا"]))) == [False] * 4 + [True] * 3 + [False]


def test_ids_are_whole_entries(spark):
    rows = ["12; ٣٤،۵|6/7&8\t9\n10", '"Smith 12, John";5', "«x 3، y» , “7”, '8', 'z, 9'", "O'Hara 4, 5", "[1, 2]", "1234567890,2147483647", "a1, 2b, 3", "", None, "4 5, 6", '"1", "2"']
    want = [[12, 34, 5, 6, 7, 8, 9, 10], [5], [7, 8], [5], [1, 2], [1234567890, 2147483647], [3], [], [], [6], [1, 2]]
    assert column(spark, rows, A.id_list) == want
    assert column(spark, ["12345678901, 3"], A.id_list) == [[3]]
