import random

import pytest
from pyspark.sql import functions as F

from quire.operators import catalog, pages, scope, search, services
from quire.operators.citation import cite
from quire.sources.tables import BOOK, books

WORDS = "ا ب ج د".split()
TIMES = ", loaded_at timestamp_ntz, deleted_at timestamp_ntz"


def texts(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, body string, foot string, matched string")


def ids(df):
    return sorted(r.i for r in df.collect())


def test_terms_may_stand_in_different_fields(spark):
    df = texts(spark, [("هذا كتاب", "على", None), ("هذا", None, None), (None, "هذا على", None), ("هذان على", None, None)])
    hits = search.search(df, ["body", "foot"], "هَذا على")
    assert ids(hits) == [0, 2]
    assert {r.i: r.matched_in for r in hits.collect()} == {0: ["body", "foot"], 2: ["foot"]}


def test_wildcards_and_options(spark):
    df = texts(spark, [("صيام", None, None), ("صام", None, None), ("صوم", None, None), ("a.b", None, None)])
    assert ids(search.search(df, ["body"], "صي*", wildcards=True)) == [0]
    assert ids(search.search(df, ["body"], "ص?م", wildcards=True)) == [1, 2]
    assert ids(search.search(df, ["body"], "صي*")) == []
    with pytest.raises(ValueError, match="OPTION_CONFLICT"):
        search.search(df, ["body"], "x", wildcards=True, morphology=True)
    with pytest.raises(ValueError, match="OPTION_NOT_SUPPORTED"):
        search.check_options(preserve=True)


def test_stems(spark):
    df = texts(spark, [("الكتاب", None, None), ("وكتابها", None, None), ("باب", None, None)])
    assert ids(search.search(df, ["body"], "كتاب", morphology=True)) == [0, 1]


def test_whole_tokens_only(spark):
    df = texts(spark, [("<b>هذا</b>ن", None, None), ("هذا،", None, None), ("هذان", None, None), ("ابن زيد", None, None), ("بنت", None, None), ("لابن", None, None), ("ه<i>ذا", None, None)])
    assert ids(search.search(df, ["body"], "هذا")) == [0, 1]
    assert ids(search.search(df, ["body"], "بن")) == ids(search.search(df, ["body"], "إبن")) == [3]
    assert ids(search.search(df, ["body"], "هذا،")) == []
    assert ids(search.search_phrase(df, ["body"], "بن زيد")) == [3]


@pytest.mark.parametrize("seed", range(3))
def test_patterns_equal_the_folds(spark, seed):
    """Search on stored text finds what the folded text and its tokens hold."""
    from quire.functions import arabic as A

    rnd = random.Random(seed)
    alphabet = "اآأإٱىيةهوؤئءبنگكپچ" + "ًٌَُِّْٰـٕٓٔ" * 2 + "   <b></i>،.\n1٢۳"
    rows = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    df = texts(spark, [(r, None, None) for r in rows])
    facts = {r.i: r for r in df.select("i", A.index_tokens(F.col("body")).alias("t"), A.verify_tokens(F.col("body")).alias("v"), *[A.exact_fold(F.col("body"), bool(k & 4), bool(k & 2), bool(k & 1)).alias(f"e{k}") for k in range(8)]).collect()}
    terms = [rnd.choice([t for r in facts.values() for t in r.t]) for _ in range(12)] + ["بن", "ا"]
    for t in terms:
        assert ids(search.search(df, ["body"], t)) == [i for i, r in facts.items() if A.fold_token(t) in r.t], t
    for _ in range(12):
        v = rnd.choice([r.v for r in facts.values() if len(r.v) > 1])
        q = v[:2]
        if A.query_tokens(" ".join(q)) == q:
            assert ids(search.search_phrase(df, ["body"], " ".join(q))) == [i for i, r in facts.items() if any(r.v[j : j + 2] == q for j in range(len(r.v)))], q
    for k in range(8):
        flags = {"diacritics": bool(k & 4), "hamza": bool(k & 2), "digits": bool(k & 1)}
        for _ in range(5):
            e = rnd.choice([r[f"e{k}"] for r in facts.values() if len(r[f"e{k}"]) > 3])
            a = rnd.randint(0, len(e) - 3)
            needle = A.fold_exact(e[a : a + 3], **flags)
            if needle and needle[0] not in A.VERIFY_DROP and needle in e:
                assert ids(search.search_exact(df, ["body"], needle, **flags)) == [i for i, r in facts.items() if needle in r[f"e{k}"]], (needle, flags)


def test_empty_query(spark):
    df = texts(spark, [("هذا", None, None)])
    assert ids(search.search(df, ["body"], " ")) == [] and ids(search.search_phrase(df, ["body"], "12")) == [] and ids(search.search_exact(df, ["body"], "")) == []


def brute_near(h, q, d):
    return any(set(q) <= set(h[i : i + d + 1]) for i in range(len(h)))


@pytest.mark.parametrize("seed", [3, 4])
def test_phrase_and_proximity_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = [[rnd.choice(WORDS) for _ in range(rnd.randint(0, 12))] for _ in range(150)]
    df = texts(spark, [(" ".join(r) if r else None, None, None) for r in rows])
    for q in (["ا", "ب"], ["ج", "ا", "ج"], ["د"]):
        got = ids(search.search_phrase(df, ["body"], " ".join(q)))
        assert got == [i for i, r in enumerate(rows) if any(r[j : j + len(q)] == q for j in range(len(r)))]
        for d in (1, 3):
            assert ids(search.search_phrase(df, ["body"], " ".join(q), "near", d)) == [i for i, r in enumerate(rows) if brute_near(r, q, d)]


def test_boolean(spark):
    df = texts(spark, [("ا ب", None, None), ("ا ج", None, None), ("ا ب د", None, None), ("ب", None, None)])
    hits = search.search_boolean(df, ["body"], ["ا"], ["ب", "ج"], ["د"])
    assert {r.i: r.matched_terms for r in hits.collect()} == {0: ["ا", "ب"], 1: ["ا", "ج"]}
    assert {r.term: r.total for r in search.term_report(df.union(df), ["body"], ["ا", "د"], ["i"]).collect()} == {"ا": 3, "د": 1}
    with pytest.raises(ValueError, match="BAD_ARG"):
        search.search_boolean(df, ["body"], none_of=["ا"])


def test_exact(spark):
    df = texts(spark, [("إلَى  ما", None, None), ("الى ما", None, None), ("<b>إلى</b> ما", None, None)])
    assert ids(search.search_exact(df, ["body"], "إلى ما")) == [0, 1, 2]
    assert ids(search.search_exact(df, ["body"], "إلى ما", hamza=True)) == [0, 2]
    assert ids(search.search_exact(df, ["body"], "إلَى ما", diacritics=True, hamza=True)) == [0]


def test_pagination(spark):
    df = spark.range(45)
    assert [r.id for r in search.paginate(df, ["id"], 20, 40).collect()] == list(range(40, 45))
    assert search.envelope(45, 20, 20) == {"total_hits": 45, "returned": 20, "offset": 20, "has_more": True, "next_offset": 40}
    assert search.envelope(45, 0, 60)["has_more"] is False
    with pytest.raises(ValueError, match="BAD_ARG"):
        search.paginate(df, ["id"], 101)


@pytest.fixture(scope="module")
def library(spark):
    """Five books, one withdrawn, one repeated later under another name."""
    from datetime import datetime

    t, u = datetime(2024, 1, 1), datetime(2024, 2, 1)
    meta = ("01011440", None, [3, 9], "«المقدمة»", " ت زيد", None, None, None, None)

    def row(i, name, cat, date, csv, main, printed, disk, m=None, at=t, gone=None):
        return (i, name, cat, 1, date, csv, main, printed, None, 0, 1, 0, disk, 0, None, m, None, at, gone)

    rows = [
        row(1, "الأول", 3, 300, "1, 2", 1, 1, 1),
        row(1, "الأول بعد", 3, 300, "1, 2", 1, 1, 1, at=u),
        row(2, None, 4, 99999, None, 0, 0, 1, meta),
        row(3, "الثالث - ط الدار", None, 0, "٣", None, 1, 0),
        row(4, "الرابع", 3, 900, "2", 77, 1, 2),
        row(5, "محذوف", 3, 900, "2", 2, 1, 2, gone=u),
    ]
    book = books(spark.createDataFrame(rows, BOOK + TIMES))
    author = spark.createDataFrame([(1, "زيد", 310), (2, "عمرو", None), (3, "بكر", 1200), (9, "خالد", 50)], "author_id int, author_name string, death_year int")
    return book, author


def test_book_view(library):
    got = {r.book_id: (r.book_name, r.book_date, r.main_author, r.downloaded) for r in library[0].collect()}
    assert got == {1: ("الأول بعد", 300, 1, True), 2: ("", None, None, True), 3: ("الثالث - ط الدار", None, None, False), 4: ("الرابع", 900, 77, True)}


def test_ordered_authors(library):
    got = {(r.book_id, r.position, r.author_id, r.role) for r in catalog.ordered_authors(*library).collect()}
    assert got == {(1, 0, 1, "main"), (1, 1, 2, "co"), (2, 0, 3, "co"), (2, 1, 9, "co"), (3, 0, 3, "co"), (4, 1, 2, "co")}


def test_scope(library):
    s = scope.Scope(book_ids=(1, 2, 3), author_ids=(2, 3), downloaded_only=True)
    assert sorted(r.book_id for r in scope.resolve(s, *library).collect()) == [1, 2]
    assert {r.source: r.contributed for r in scope.diagnostics(s, *library).collect()} == {"book_ids": 3, "author_ids": 4, "downloaded_only": 3, "intersection": 2}
    assert scope.resolve(None, *library).count() == scope.resolve(scope.Scope(), *library).count() == 4
    assert sorted(r.book_id for r in scope.resolve(scope.Scope(period_from=1, period_to=310), *library).collect()) == [1, 2]
    for bad in ({"book_ids": (0,)}, {"period_from": 0}, {"period_to": 2001}):
        with pytest.raises(ValueError, match="BAD_ARG"):
            scope.Scope(**bad)


def test_by_period(library):
    assert [r.book_id for r in catalog.by_period(*library, composed=(None, 300), died=(300, None)).collect()] == [1]
    with pytest.raises(ValueError, match="BAD_ARG"):
        catalog.by_period(*library)


def test_cards_and_status(spark, library):
    page = spark.createDataFrame([(1, 1), (1, 2)], "book_id int, page_id int")
    text = spark.createDataFrame([(1, 1, "<b>تحقيق</b>: أحمد علي، طبعة\nالناشر: دار س. 1", None)], "book_id int, page_id int, body string, foot string")
    got = {r.book_id: (r.content_status, r.edition, r.editor, r.publisher) for r in catalog.book_cards(*library, page, text).collect()}
    assert got[1] == ("readable", None, "أحمد علي", "دار س")
    assert got[2] == ("downloaded_no_pages", "ت زيد", "زيد", None)
    assert got[3] == ("not_downloaded", "ط الدار", None, "الدار")
    front = "تَحقِيق :  زيد بن علي - عمرو (ط 2)\nدار النشر： س ص/ بلد"
    for body, want in ((front, ("زيد بن علي - عمرو", "س ص")), ("حقّقه وعلّق عليه وقدم له أبو س، ج\nالناشر: ", ("أبو س", None)), ("حققه: س", (None, None)), (f"تحقيق: {'س' * 71}", (None, None)), ("التحقيق في الكتاب", (None, None))):
        r = catalog.book_cards(*library, page, spark.createDataFrame([(1, 1, body, None)], text.schema)).where("book_id = 1").first()
        assert (r.editor, r.publisher) == want
    h = catalog.health(*library, page).first()
    assert (h.catalog_books, h.downloaded_books, h.sampled, h.readable, h.status) == (4, 3, 3, 1, "ok")


def test_citations(spark, library):
    page = spark.createDataFrame([(1, 1, " 5 ", 285), (1, 2, "الكتاب", None), (2, 1, None, 17)], "book_id int, page_id int, part string, page int")
    got = {(r.book_id, r.page_id): r for r in cite(page, *library).collect()}
    assert got[1, 1].default_style == "«الأول بعد» (٥/ ٢٨٥)"
    assert got[1, 2].default_style == "«الأول بعد»"
    assert got[2, 1].default_style == "«المقدمة» (ص ١٧ ت زيد بترقيم آلي)"
    assert got[1, 1].short_style == "زيد، الأول بعد، ج ٥، ص ٢٨٥."
    assert got[1, 1].full_style == "زيد (ت ٣١٠هـ). الأول بعد. ٣٠٠هـ، ج ٥، ص ٢٨٥."
    assert got[2, 1].full_style == "المقدمة. ص ١٧، بترقيم آلي."
    assert (got[1, 1].n_missing, got[2, 1].n_missing) == (4, 6)


def test_coverage(spark, library):
    per = spark.createDataFrame([(1, 5), (2, 2), (4, 5), (99, 7)], "book_id int, n_hits long")
    got = {(r.kind, r.id): r.n_hits for r in search.coverage(per, *library, top=2).collect()}
    assert got == {("category", 3): 10, ("category", 4): 2, ("century", 3): 5, ("century", 9): 5, ("century", None): 2, ("book", 1): 5, ("book", 4): 5, ("author", 1): 5}


def title_rows(spark, rows):
    return spark.createDataFrame(rows, "book_id int, id int, page int, parent int, body string")


def test_owner_is_the_largest_id(spark):
    rnd = random.Random(5)
    titles = [(b, i, rnd.randint(1, 5000), 0, "t") for b in (1, 2) for i in range(1, 40)]
    page = spark.createDataFrame([(b, p) for b in (1, 2, 3) for p in range(1, 5000, 37)], "book_id int, page_id int")
    got = {(r.book_id, r.page_id): r.title_id for r in pages.owning_titles(page, title_rows(spark, titles)).collect()}
    for (b, p), t in got.items():
        assert t == max((i for bb, i, pp, *_ in titles if bb == b and pp <= p), default=None)
    one = pages.owning_titles(page.limit(0).union(spark.createDataFrame([(1, 5)], "book_id int, page_id int")), title_rows(spark, [(1, 1, 5, 0, ""), (1, 2, 2, 0, "")])).first()
    assert one.title_id == 2


def test_sections(spark):
    page = spark.createDataFrame([(1, i) for i in range(1, 11)], "book_id int, page_id int")
    t = title_rows(spark, [(1, 1, 1, None, ""), (1, 2, 3, 1, ""), (1, 3, 7, 0, "")])
    assert {r.title_id: (r.start_page_id, r.end_page_id) for r in pages.sections(t, page).collect()} == {1: (1, 6), 2: (3, 10), 3: (7, 10)}


def test_toc(spark):
    t = title_rows(spark, [(1, 1, 1, None, "a"), (1, 2, 3, 1, "b"), (1, 3, 4, 2, "c"), (1, 4, 5, 3, "d")])
    got = {r.title_id: (r.level, r.has_children) for r in pages.toc(t, 0, 3).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, True)}
    assert [r.title_id for r in pages.toc(t, 3, 1).collect()] == [4]
    with pytest.raises(ValueError, match="BAD_ARG"):
        pages.toc(t, 0, 6)


def test_neighbours_across_ranges(spark):
    page = spark.createDataFrame([(1, p) for p in (1, 2, 1500, 5000)], "book_id int, page_id int")
    got = {r.page_id: (r.prev_page_id, r.next_page_id) for r in pages.neighbours(page).collect()}
    assert got == {1: (None, 2), 2: (1, 1500), 1500: (2, 5000), 5000: (1500, None)}


def test_sections_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pages, "RANGE", 4)
    rnd = random.Random(8)
    rows = [(b, i, rnd.choice([None, rnd.randint(1, 50)]), rnd.choice([None, 0, 1, 2, 9]), "") for b in (1, 2) for i in rnd.sample(range(1, 200), 60)]
    page = spark.createDataFrame([(1, 40), (1, 3)], "book_id int, page_id int")
    got = {(r.book_id, r.title_id): r.end_page_id for r in pages.sections(title_rows(spark, rows), page).collect()}
    kept = sorted((b, p or 0, i, g) for b, i, g, p, _ in rows if g is not None)
    for b, p, i, g in kept:
        later = [x[3] for x in kept if x[:2] == (b, p) and x[2] > i]
        assert got[b, i] == max(g, later[0] - 1 if later else 40 if b == 1 else 0)


def test_budgets(spark):
    from pyspark.sql import Window

    w = Window.partitionBy("g").orderBy("n")
    df = spark.createDataFrame([(1, 1, 9), (1, 2, 5), (1, 3, 9), (2, 1, 9), (2, 2, 9), (2, 3, 9), (3, 1, 99)], "g int, n int, size int")
    kept = df.select("g", pages.budget_inclusive(F.col("size"), w, 15).alias("a"), pages.budget_exclusive(F.col("size"), w, 15).alias("b")).groupBy("g").agg(F.count_if("a").alias("a"), F.count_if("b").alias("b"))
    assert {r.g: (r.a, r.b) for r in kept.collect()} == {1: (2, 3), 2: (1, 2), 3: (1, 1)}


def test_annotations(spark):
    rows = [(1, 1, '{"ayat":[1,2],"hadeeth":[7],"esnad":["x"]}'), (1, 2, "{bad"), (1, 3, "{}"), (1, 4, None)]
    got = {r.page_id: (r.valid, r.ayat, r.hadeeth, r.esnad) for r in pages.annotations(spark.createDataFrame(rows, "book_id int, page_id int, services string")).collect()}
    assert got == {1: (True, [1, 2], [7], ["x"]), 2: (False, [], [], []), 3: (True, [], [], [])}


def test_fetch_keeps_the_asked_order(spark):
    page = spark.createDataFrame([(1, 1, None, 5), (1, 2, None, 6)], "book_id int, page_id int, part string, page int")
    text = spark.createDataFrame([(1, 2, "b", None)], "book_id int, page_id int, body string, foot string")
    assert [(r.page_id, r.found, r.body) for r in pages.fetch(page, text, [(1, 2), (9, 9), (1, 1)]).collect()] == [(2, True, "b"), (9, False, None), (1, True, None)]


def test_fetch_titles(spark):
    t = title_rows(spark, [(1, 1, 1, 0, "a"), (1, 2, 1, 0, None)])
    assert [(r.title_id, r.body) for r in pages.fetch_titles(t, [(1, 2), (1, 9), (1, 1)]).collect()] == [(2, ""), (9, ""), (1, "a")]


def test_verse_services(spark, library):
    service = spark.createDataFrame([("tafseer", 1, 1, 4), ("tafseer", 1, 1, 2), ("tafseer", 9, 4, 3), ("tafseer", 1, 50, 1)], "service_name string, key_id int, book_id int, page_id int")
    got = [(r.book_id, r.status, r.page_id) for r in services.verse_coverage(service, *library, 1).collect()]
    assert got == [(1, "indexed_covers", 2), (50, "indexed_covers", 1), (4, "indexed_no_entry_for_this_aya", None), (2, "not_indexed_coverage_unknown", None)]
    totals = {r.aya_id: (r.indexed_covers, r.indexed_no_entry, r.not_indexed) for r in services.coverage_totals(service, library[0]).collect()}
    assert totals[1] == (2, 1, 1)
    assert [r.status for r in services.source_status(service, library[0], 1, [4, 1, 50, 3]).collect()] == ["no_entry_for_this_aya", "ok", "not_downloaded", "not_indexed"]


def test_autocomplete(spark):
    df = spark.createDataFrame([(1, "كتاب"), (2, "كتاب العلم"), (3, "باب"), (4, None)], "k int, name string")
    got = search.autocomplete(df, "k", "name", "كتا", "book").collect()
    assert [r.id for r in got] == [1, 2] and got[0].score > got[1].score


def test_ranked(spark):
    df = spark.createDataFrame([(i * 977,) for i in range(50)], "v int")
    assert {(r.v, r["rank"]) for r in catalog._ranked(df, "v").collect()} == {(i * 977, i) for i in range(50)}
