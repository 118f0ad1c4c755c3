import sqlite3
from types import SimpleNamespace

import pytest

from quire import render
from quire.errors import CODES, LibraryError
from quire.library import GUIDE, Toolbox
from quire.operators.scope import Scope
from quire.sources.sqlite import SqliteDataSource


@pytest.fixture(scope="module")
def box(spark, sf_dir):
    return Toolbox(spark, sf_dir)


@pytest.fixture(scope="module")
def a_page(box):
    r = box.t.page.join(box.t.page_text, ["book_id", "page_id"]).join(box.t.book.where("downloaded"), "book_id").where("body <> ''").orderBy("book_id", "page_id").first()
    return r.book_id, r.page_id


def test_search_tools(box):
    got = box.search_pages("في", limit=3)["data"]
    assert got["returned"] == len(got["results"]) <= 3 and got["total_hits"] >= got["returned"] and got["normalized_tokens"] == ["في"]
    assert "<mark>" in got["results"][0]["snippet_body"] + got["results"][0]["snippet_foot"]
    for tool in (box.search_titles, box.search_authors, box.search_books, box.search_phrase, box.search_exact, box.search_hadith):
        assert tool("في")["data"]["total_hits"] >= 0
    assert box.search_boolean(["في"], none_of=["من"])["data"]["subqueries"]
    assert box.root_stats("كتاب")["data"]["root"] == "كتاب"
    assert box.resolve("كتا")["data"]["query"] == "كتا"


def test_searches_over_a_saved_index(box, tmp_path):
    """The same pages, fields, excerpts and reports as a scan, in windows, with and without a scope."""
    fast = box.build_index(f"{tmp_path}/index")
    books = tuple(r.book_id for r in box.t.page_text.select("book_id").distinct().orderBy("book_id").limit(4).collect())
    calls = [
        lambda b: b.search_pages("في من", limit=4, offset=1), lambda b: b.search_pages("في", Scope(book_ids=books), ("foot", "comment")), lambda b: b.search_phrase("من هذا", limit=5),
        lambda b: b.search_phrase("من على", "near", 6, Scope(book_ids=books)), lambda b: b.search_boolean(["في"], ["من", "على"], ["قبل"], limit=3), lambda b: b.search_boolean(any_of=["هذا"], none_of=["في"], scope=Scope(book_ids=books)),
        lambda b: b.search_hadith("في"), lambda b: b.search_pages("لاشيءهنا"), lambda b: b.search_pages(" "),
        lambda b: b.search_pages("ال* ?ن", limit=3, wildcards=True), lambda b: b.search_pages("كتاب في", limit=3, morphology=True), lambda b: b.root_stats("هذا"),
    ]
    for call in calls:
        got, want = call(fast)["data"], call(box)["data"]
        if "distribution" in got:
            assert got["distribution"] and sorted(map(str, got.pop("distribution"))) == sorted(map(str, want.pop("distribution")))
        if "subqueries" in got:
            assert sorted(map(str, got.pop("subqueries"))) == sorted(map(str, want.pop("subqueries")))
        assert {k: v for k, v in got.items() if k != "coverage"} == {k: v for k, v in want.items() if k != "coverage"}
    hit = fast.search_phrase("من هذا", limit=1)["data"]["results"][0]
    assert hit["book_name"] and "<mark>" in hit["snippet_body"] + hit["snippet_foot"]
    assert "snippet_body" in box.search_exact("هذا", limit=1, search_in=("body",), hamza=True)["data"]["results"][0]


def test_scope_errors(box):
    with pytest.raises(LibraryError, match="EMPTY_SCOPE") as e:
        box.search_pages("في", Scope(category_ids=(1,), book_ids=(999_999_999,)))
    assert e.value.details["diagnostics"][-1]["contributed"] == 0
    with pytest.raises(LibraryError, match="BAD_ARG"):
        box.search_books("x", Scope(book_ids=(1,)))
    with pytest.raises(TypeError):
        Scope(nothing=1)


def test_reading_tools(box, a_page):
    book, page = a_page
    got = box.get_page(book, page)["data"]
    assert got["text"] and got["total_parts"] >= 1
    assert box.get_pages_range(book, page, 2)["data"]["pages"]
    assert box.get_book(book)["data"]["content_status"] == "readable"
    assert box.get_citation(book, page)["data"]["formatted"].startswith("«")
    assert box.get_citation(book, style="full")["data"]["notes"]
    assert box.get_toc(book, 0, 2)["data"]["titles"] is not None
    assert "parts" in box.get_book_parts(book)["data"] and "ayat" in box.get_page_services(book, page)["data"]
    title = box.t.title.where(f"book_id = {book} and page is not null").first()
    if title:
        assert box.get_book_section(book, title.id)["data"]["title_id"] == title.id
    with pytest.raises(LibraryError, match="PAGE_NOT_FOUND"):
        box.get_page(book, 10_000_000)
    with pytest.raises(LibraryError, match="BOOK_NOT_FOUND"):
        box.get_page(-1, 1)


def test_catalogue_and_keys(box):
    assert box.list_categories()["data"]["categories"] and box.list_downloaded_books()["data"]["by_category"]
    assert box.books_by_period(composed=(1, 1500))["data"]["total_hits"] > 0
    assert box.health()["data"]["status"] == "ok"
    assert box.get_aya(surah=2, aya=255)["data"]["aya_id"] == 262
    entry = {r.service_name: r.key_id for r in box.t.service.join(box.t.book, "book_id").orderBy("key_id").collect()}
    assert box.get_tafseer_of_aya(aya_id=entry["tafseer"], downloaded_only=False)["data"]["entries"]
    assert box.get_books_for_hadith(entry["hadeeth"])["data"]["key"] == entry["hadeeth"]
    for tool in (lambda: box.get_books_for_hadith(987_654_321), lambda: box.get_tafseer_of_aya(aya_id=6236 if entry["tafseer"] != 6236 else 6235)):
        with pytest.raises(LibraryError, match="SERVICE_KEY_NOT_FOUND") as e:
            tool()
        assert e.value.details["key"]
    got = box.list_tafsirs_for_aya(aya_id=1)["data"]
    assert sum(got["totals"].values()) == len(got["books"])
    assert "sources" in box.get_tafseer_texts(aya_id=1)["data"]
    with pytest.raises(LibraryError, match="AYA_NOT_FOUND"):
        box.get_aya(surah=1, aya=8)
    assert box.guide("scope") == GUIDE["scope"] and box.guide("nothing") == GUIDE["start"]


@pytest.fixture(scope="module")
def small(spark):
    """A box over 13 books that all treat verse 1, with 5,000 characters each, and stand under two tradition keys 60 times each."""
    books = spark.createDataFrame([(b, f"b{b}", 0, 3, True) for b in range(1, 14)], "book_id int, book_name string, main_author int, book_category int, downloaded boolean")
    keys = [("tafseer", 1, b, 1) for b in range(1, 14)] + [("hadeeth", k, 1 + i % 13, i) for k in (7, 8) for i in range(60)] + [("hadeeth", 9, 1, i) for i in range(130)]
    text = spark.createDataFrame([(b, 1, "x" * 5000 if b > 1 else "كلمة", "", None) for b in range(1, 14)], "book_id int, page_id int, body string, foot string, comment string")
    page = spark.createDataFrame([(1, 1, '{"hadeeth":[7,8]}')], "book_id int, page_id int, services string")
    out = object.__new__(Toolbox)
    out.t = SimpleNamespace(book=books, author=spark.createDataFrame([], "author_id int, author_name string, death_year int"), service=spark.createDataFrame(keys, "service_name string, key_id int, book_id int, page_id int"), page_text=text, page_text_rows=text, page=page)
    return out


@pytest.fixture(scope="module")
def long_book(spark):
    """A downloaded book of 40 pages with 1,000 characters each, titles 1 > 2 > 3 and 9, two authors of whom one is a co-author."""
    out = object.__new__(Toolbox)
    out.spark = spark
    page = spark.createDataFrame([(1, i, None, i) for i in range(1, 41)], "book_id int, page_id int, part string, page int")
    text = spark.createDataFrame([(1, i, f"<b>{i}</b>" + "x" * 999, "") for i in range(1, 41)], "book_id int, page_id int, body string, foot string")
    title = spark.createDataFrame([(1, 1, 1, 0, "a"), (1, 2, 5, 1, "b"), (1, 3, 7, 2, "c"), (1, 40_000, 30, 3, "far"), (1, 50_000, 35, 60_000, "loop"), (1, 60_000, 36, 50_000, "loop")], "book_id int, id int, page int, parent int, body string")
    book = spark.createDataFrame([(1, "one", 1, "2", 3, 700, True, ([], "edited", "by hand", None)), (2, "two", 2, None, 3, None, True, ([1], None, None, "1410"))], "book_id int, book_name string, main_author int, authors_csv string, book_category int, book_date int, downloaded boolean, meta_data struct<coauthor:array<int>,prefix:string,suffix:string,date:string>")
    author = spark.createDataFrame([(1, "Zaid", 700, "born in Basra"), (2, "Amr", None, None)], "author_id int, author_name string, death_year int, death_text string")
    out.t = SimpleNamespace(page=page, page_text=text, page_text_rows=text, title=title, book=book, author=author)
    return out


def test_section_stops_at_the_budget(long_book):
    got = long_book.get_book_section(1, 1, max_pages=30)["data"]
    assert [p["page_id"] for p in got["pages"]] == list(range(1, 12)) and got["truncated"] and got["next_start_page_id"] == 12 and "12000 characters" in got["notice"]
    got = long_book.get_book_section(1, 1, max_pages=3)["data"]
    assert len(got["pages"]) == 3 and got["next_start_page_id"] == 4 and "3 pages" in got["notice"]
    got = long_book.get_book_section(1, 40_000)["data"]
    assert got["total_pages"] == 11 and not got["truncated"] and got["next_start_page_id"] is None and got["notice"] is None


def test_chain_of_titles_that_holds_a_page(long_book):
    got = long_book.get_toc(1, containing_page_id=8)["data"]
    assert got["mode"] == "ancestor_chain" and [t["body"] for t in got["ancestor_chain"]] == ["a", "b", "c"]
    assert [t["body"] for t in long_book.get_toc(1, containing_page_id=33)["data"]["ancestor_chain"]] == ["a", "b", "c", "far"]  # over two cells of ids
    assert long_book.get_toc(1, containing_page_id=38)["data"]["ancestor_chain"] == [] and long_book.get_toc(1)["data"]["mode"] == "subtree"
    page = long_book.get_page(1, 8)["data"]
    assert page["titles"] == [1, 2, 3] and (page["prev_page_id"], page["next_page_id"]) == (7, 9) and page["text"].startswith("8x") and long_book.get_page(1, 8, keep_html=True)["data"]["text"].startswith("<b>8</b>")
    assert (long_book.get_page(1, 1)["data"]["prev_page_id"], long_book.get_page(1, 40)["data"]["next_page_id"]) == (None, None)


def test_catalogue_search_looks_at_all_authors_bibliography_and_biography(long_book):
    found = lambda q: [r["book_id"] for r in long_book.search_books(q)["data"]["results"]]
    assert found("Zaid") == [1, 2] and found("Amr") == [1, 2] and found("hand") == [1] and found("1410") == [2] and found("edited Amr") == [1] and found("none") == []
    assert [r["author_id"] for r in long_book.search_authors("Basra")["data"]["results"]] == [1]


def test_markdown(long_book):
    text = long_book.get_toc(1, depth=2, response_format="markdown")["text"]
    assert "## titles" in text and "| title_id |" in text and "mode: subtree" in text
    with pytest.raises(LibraryError, match="BAD_ARG"):
        long_book.get_toc(1, response_format="xml")
    assert render.as_markdown({"a": 1, "b": ["x"], "c": {"d": 2}, "e": "l\nm", "f": []}) == "a: 1\n\n## b\n\n- x\n\n## c\n\nd: 2\n\n## e\n\nl\nm\n\n## f\n\n_no rows_"


def test_every_source_of_a_verse_can_be_asked_for(small):
    got = small.get_tafseer_texts(book_ids=[6], aya_id=1)["data"]
    assert [(r["book_id"], len(r["text"])) for r in got["sources"]] == [(6, 5000)] and got["remaining_book_ids"] == []
    seen, left = [], None
    while left is None or left:
        got = small.get_tafseer_texts(book_ids=left, aya_id=1)["data"]
        seen += [r["book_id"] for r in got["sources"]]
        left = got["remaining_book_ids"]
        assert len(seen) + len(left) == 13
    assert seen == list(range(1, 14))


def test_every_entry_of_a_key(small):
    got = small.get_books_for_hadith(9)["data"]
    assert got["total"] == got["returned"] == 130 and [r["page_id"] for r in got["entries"]] == list(range(130))


def test_every_entry_of_the_keys_that_a_search_finds(small):
    seen, at = [], 0
    while at is not None:
        got = small.search_hadith("كلمة", takhrij_offset=at)["data"]
        assert got["takhrij_window"]["total_hits"] == 120 and got["total_hits"] == 1
        seen += [(r["key_id"], r["book_id"], r["page_id"]) for r in got["takhrij"]]
        at = got["takhrij_window"].get("next_offset")
    assert seen == sorted((k, 1 + i % 13, i) for k in (7, 8) for i in range(60))
    assert small.search_hadith("كلمة", offset=1)["data"]["results"] == []


def test_resources(box):
    for name in ("categories", "downloaded", "schema", "status"):
        assert box.resource(name)["data"]
    assert box.resource("guide") == GUIDE["start"]
    with pytest.raises(LibraryError, match="BAD_ARG"):
        box.resource("nothing")


def test_rendering():
    short = render.render({"a": 1})
    assert short == {"text": '{\n  "a": 1\n}', "data": {"a": 1}}
    long = render.render({"a": "x" * 30_000}, lambda p: p["a"])
    assert long["data"]["truncated"] and long["text"].startswith("x" * 24_800 + "\n\n[Cut from 30000")
    assert render.limited("y" * 25_000) == ("y" * 25_000, None)
    assert render.bold_marks("a <mark>b</mark>") == "a **b**" and render.header(2, "x") == "## x" and render.meta(a=1, b=None) == "a: 1"
    assert render.markdown_table([{"a": "x|y", "b": None}]).endswith("| x\\|y |  |") and render.markdown_table([]) == "_no rows_"


def test_errors():
    with pytest.raises(ValueError):
        LibraryError("NO_SUCH_CODE", "x")
    assert all(LibraryError(c, "x").code == c for c in CODES)


def test_sqlite_source(spark, tmp_path):
    for book in (7, 12):
        con = sqlite3.connect(tmp_path / f"{book}.db")
        con.execute("create table page (id integer primary key, part text, page int, services text)")
        con.executemany("insert into page values (?, ?, ?, ?)", [(i, None if i % 2 else "1", i, None) for i in range(1, 26)])
        con.commit()
        con.close()
    (tmp_path / "broken.db").write_bytes(b"")
    spark.dataSource.register(SqliteDataSource)
    df = spark.read.format("sqlite").schema("book_id int, page_id int, part string, page int").option("path", f"{tmp_path}/*.db").option("table", "page").option("rename", "id=page_id").option("file_id", "book_id").option("rows", "10").load()
    assert sorted(map(tuple, df.collect())) == [(b, i, None if i % 2 else "1", i) for b in (7, 12) for i in range(1, 26)]
    assert df.rdd.getNumPartitions() == 6
