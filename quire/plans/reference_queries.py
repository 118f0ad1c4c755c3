"""Search, catalogue, page and service queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import arabic, verses
from quire.functions.snippets import exact_snippet_column, parts_column, snippet_column
from quire.operators import catalog, pages, postings, scope, search, services
from quire.operators.citation import cite
from quire.sources.tables import Library

PAGE_FIELDS = ["body", "foot"]
#: A scope used by several queries.
SCOPE = scope.Scope(category_ids=(1, 2, 3, 4, 5, 6), period_from=300, period_to=1200, downloaded_only=True)
AYA = 1


def _hits(found: DataFrame, *more: Column) -> DataFrame:
    """The hits' keys and further columns, once per page: text rows may be stored repeatedly."""
    return found.select("book_id", "page_id", *more).distinct()


def _fields() -> Column:
    return F.array_join("matched_in", ",").alias("matched_in")


def search_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose body or foot hold both words, with book, author, category and printed label."""
    lib = Library(spark, d)
    hits = lib.index("page_text").search(PAGE_FIELDS, "هذا على").withColumn("matched_in", _fields())
    return search.enrich(hits, lib.book, lib.author, lib.page)


def search_pages_scoped(spark: SparkSession, d: str) -> DataFrame:
    """The same search inside a scope of categories, period and availability."""
    lib = Library(spark, d)
    return scope.within(lib.index("page_text").search(PAGE_FIELDS, "هذا على").select("book_id", "page_id"), SCOPE, lib.book, lib.author)


def search_pages_window(spark: SparkSession, d: str) -> DataFrame:
    """The second window of twenty hits, by book and page."""
    lib = Library(spark, d)
    return search.paginate(lib.index("page_text").search(PAGE_FIELDS, "هذا على").select("book_id", "page_id"), ["book_id", "page_id"], 20, 20)


def search_pages_coverage(spark: SparkSession, d: str) -> DataFrame:
    """All hits of a search by category, century, top books and top authors."""
    lib = Library(spark, d)
    return search.coverage(search.hits_per_book(lib.index("page_text").search(PAGE_FIELDS, "هذا على")), lib.book, lib.author)


def search_pages_wildcard(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a word of a pattern."""
    return Library(spark, d).index("page_text").matching(["body", "foot", "comment"], "است*اح", wildcards=True).withColumn("matched_in", _fields())


def search_pages_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Hits with marked excerpts."""
    hits = search.search(Library(spark, d).page_text_rows, PAGE_FIELDS, "هذا على").dropDuplicates(["book_id", "page_id"])
    terms = arabic.fold_query("هذا على")
    return hits.select("book_id", "page_id", snippet_column(F.col("body"), terms).alias("snippet_body"), snippet_column(F.col("foot"), terms).alias("snippet_foot"))


def search_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles that hold a word, with their parent."""
    lib = Library(spark, d)
    hits = lib.index("title").search(["body"], "في باب").select("book_id", "id")
    return lib.title.join(hits, ["book_id", "id"], "left_semi").select("book_id", F.col("id").alias("title_id"), "page", "parent", "body")


def search_books(spark: SparkSession, d: str) -> DataFrame:
    """Books whose name or main author's name holds the word."""
    lib = Library(spark, d)
    b = catalog.with_main_author(lib.book, lib.author)
    return search.search(b, ["book_name", "author_name"], "كتاب").select("book_id", "book_name", "author_name", F.col("book_category").alias("category_id"), "book_date")


def search_books_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Matching books by category and century."""
    lib = Library(spark, d)
    hits = search.search(catalog.with_main_author(lib.book, lib.author), ["book_name", "author_name"], "كتاب")
    return search.coverage(search.hits_per_book(hits, ()), lib.book, lib.author).where("kind in ('category', 'century')")


def search_authors(spark: SparkSession, d: str) -> DataFrame:
    """Authors whose name holds the word, with death year and number of books."""
    lib = Library(spark, d)
    cards = catalog.author_cards(lib.book, lib.author).select("author_id", "author_name", "death_year", "book_count")
    return search.search(cards, ["author_name"], "أبو").select("author_id", "author_name", "death_year", "book_count")


def search_phrase(spark: SparkSession, d: str) -> DataFrame:
    """Pages with two words next to each other."""
    return Library(spark, d).index("page_text").phrase(PAGE_FIELDS, "من هذا").withColumn("matched_in", _fields())


def search_near(spark: SparkSession, d: str) -> DataFrame:
    """Pages with three words within ten places."""
    return Library(spark, d).index("page_text").near(PAGE_FIELDS, "من هذا على", 10).withColumn("matched_in", _fields())


def search_exact(spark: SparkSession, d: str) -> DataFrame:
    """Pages that hold a string with its hamza, marks and digits folded."""
    return _hits(search.search_exact(Library(spark, d).page_text_rows, PAGE_FIELDS, "إلى ما", hamza=True), _fields())


def search_exact_snippets(spark: SparkSession, d: str) -> DataFrame:
    """The same with the raw text around the match."""
    hits = search.search_exact(Library(spark, d).page_text_rows, ["body"], "إلى ما", hamza=True).dropDuplicates(["book_id", "page_id"])
    return hits.select("book_id", "page_id", exact_snippet_column(F.col("body"), arabic.fold_exact("إلى ما", hamza=True), hamza=True).alias("snippet"))


def search_exact_flags(spark: SparkSession, d: str) -> DataFrame:
    """Matching pages at each of the eight exactness settings, counted in one pass."""
    tests, counts, rows = [], [], []
    for i in range(8):
        flags = {"diacritics": bool(i & 4), "hamza": bool(i & 2), "digits": bool(i & 1)}
        needle = arabic.fold_exact("إلى", **flags)
        tests.append(F.max(arabic.exact_fold(F.coalesce("body", F.lit("")), **flags).contains(needle)).alias(f"c{i}"))
        counts.append(F.count_if(f"c{i}").alias(f"c{i}"))
        rows.append(F.struct(*[F.lit(v).alias(k) for k, v in flags.items()], F.col(f"c{i}").alias("n_pages")))
    per_page = Library(spark, d).page_text_rows.groupBy("book_id", "page_id").agg(*tests)
    return per_page.agg(*counts).select(F.inline(F.array(*rows)))


def search_boolean(spark: SparkSession, d: str) -> DataFrame:
    """All of, any of and none of, with the terms that matched."""
    hits = Library(spark, d).index("page_text").boolean(PAGE_FIELDS, ["هذا"], ["قبل", "بعد"], ["كان"])
    return hits.withColumn("matched_terms", F.array_join("matched_terms", ","))


def search_boolean_report(spark: SparkSession, d: str) -> DataFrame:
    """Pages per sub-query."""
    return Library(spark, d).index("page_text").report(PAGE_FIELDS, ["هذا", "قبل", "بعد", "كان"])


def root_stats(spark: SparkSession, d: str) -> DataFrame:
    """Distribution of the pages with words of one (approximate) stem."""
    lib = Library(spark, d)
    hits = lib.index("page_text").matching(PAGE_FIELDS, "استفزاط", morphology=True)
    return search.coverage(search.hits_per_book(hits), lib.book, lib.author, 15)


def resolve_names(spark: SparkSession, d: str) -> DataFrame:
    """Autocomplete over books and authors, the best ten of each."""
    lib = Library(spark, d)
    return search.autocomplete(lib.book, "book_id", "book_name", "كتا", "book").unionByName(search.autocomplete(lib.author, "author_id", "author_name", "أبو", "author"))


def search_verses(spark: SparkSession, d: str) -> DataFrame:
    """Short texts that hold a word with or without particles and the article; titles stand in for verses here."""
    t = Library(spark, d).title.select("book_id", "id", "body")
    return search.verse_search(t, "body", "id", "فصل").select("book_id", F.col("id").alias("title_id"), "body")


def page_cards(spark: SparkSession, d: str) -> DataFrame:
    """Every page with label, neighbours and the length of its displayed text."""
    lib = Library(spark, d)
    return pages.page_sizes(lib.page, lib.page_text_rows)


def page_parts(spark: SparkSession, d: str) -> DataFrame:
    """Displayed page texts cut into parts of the budget."""
    t = Library(spark, d).page_text.where("body is not null")
    return t.select("book_id", "page_id", F.posexplode(parts_column(arabic.plain_text(F.col("body")), 500)).alias("part", "text"))


def page_chains(spark: SparkSession, d: str) -> DataFrame:
    """Every page with its owning title and the chain of titles above it."""
    lib = Library(spark, d)
    return pages.page_chains(lib.page, lib.title).withColumn("chain", F.array_join(F.col("chain").cast("array<string>"), "/"))


def page_services(spark: SparkSession, d: str) -> DataFrame:
    """Parsed annotations of every page that has any."""
    j = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return pages.annotations(Library(spark, d).page).select("book_id", "page_id", "valid", j("ayat"), j("hadeeth"), F.size("esnad").alias("n_esnad"))


def page_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty pages of every book within the character budget."""
    lib = Library(spark, d)
    return pages.page_range(lib.page, lib.page_text_rows)


def toc(spark: SparkSession, d: str) -> DataFrame:
    """Two levels of every table of contents."""
    return pages.toc(Library(spark, d).title, 0, 2)


def book_sections(spark: SparkSession, d: str) -> DataFrame:
    """Every title with its pages."""
    lib = Library(spark, d)
    return pages.sections(lib.title, lib.page)


def book_parts(spark: SparkSession, d: str) -> DataFrame:
    """Volumes of every book."""
    return pages.parts(Library(spark, d).page)


def book_cards(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of every book."""
    lib = Library(spark, d)
    return catalog.book_cards(lib.book, lib.author, lib.page, lib.page_text)


def book_authors(spark: SparkSession, d: str) -> DataFrame:
    """Authors of every book in order, with their role."""
    lib = Library(spark, d)
    return catalog.ordered_authors(lib.book, lib.author)


def author_cards(spark: SparkSession, d: str) -> DataFrame:
    """Every author with all books."""
    lib = Library(spark, d)
    return catalog.author_cards(lib.book, lib.author).withColumn("book_ids", F.array_join(F.col("book_ids").cast("array<string>"), ","))


def list_categories(spark: SparkSession, d: str) -> DataFrame:
    """Books and downloaded books per category."""
    return catalog.categories(Library(spark, d).book, downloaded_only=True)


def downloaded_books(spark: SparkSession, d: str) -> DataFrame:
    """Downloaded books with content status."""
    lib = Library(spark, d)
    return catalog.downloaded_books(lib.book, lib.page)


def downloaded_tally(spark: SparkSession, d: str) -> DataFrame:
    """Downloaded books per category, -1 without one."""
    return catalog.library_tally(Library(spark, d).book)


def books_by_period(spark: SparkSession, d: str) -> DataFrame:
    """Books written and authors dead within ranges of years."""
    lib = Library(spark, d)
    return catalog.by_period(lib.book, lib.author, composed=(200, 900), died=(None, 800))


def scope_books(spark: SparkSession, d: str) -> DataFrame:
    """Books of a scope."""
    lib = Library(spark, d)
    return scope.resolve(SCOPE, lib.book, lib.author)


def scope_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Size of each source of a scope and of their intersection."""
    lib = Library(spark, d)
    return scope.diagnostics(SCOPE, lib.book, lib.author)


def library_health(spark: SparkSession, d: str) -> DataFrame:
    """Counts and a readability sample."""
    lib = Library(spark, d)
    return catalog.health(lib.book, lib.author, lib.page)


def citations(spark: SparkSession, d: str) -> DataFrame:
    """Three references to every page."""
    lib = Library(spark, d)
    return cite(lib.page, lib.book, lib.author)


def verse_entries(spark: SparkSession, d: str) -> DataFrame:
    """Every commentary entry with sura, verse, book and availability."""
    lib = Library(spark, d)
    return services.verse_entries(lib.service, lib.book, lib.author)


def tradition_entries(spark: SparkSession, d: str) -> DataFrame:
    """Every tradition entry in a downloaded book."""
    lib = Library(spark, d)
    return services.entries(lib.service, "hadeeth", lib.book, lib.author, downloaded_only=True)


def verse_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Which books treat one verse, take part without treating it, or are not indexed."""
    lib = Library(spark, d)
    return services.verse_coverage(lib.service, lib.book, lib.author, AYA)


def verse_coverage_totals(spark: SparkSession, d: str) -> DataFrame:
    """The three counts for every verse with an entry."""
    lib = Library(spark, d)
    return services.coverage_totals(lib.service, lib.book)


def verse_texts(spark: SparkSession, d: str) -> DataFrame:
    """Passages of the downloaded sources of one verse."""
    lib = Library(spark, d)
    return services.verse_texts(lib.service, lib.book, lib.author, lib.page_text, AYA).select("book_id", "page_id", "n_chars", "status")


def tradition_matches(spark: SparkSession, d: str) -> DataFrame:
    """Pages that match a text, with their tradition keys."""
    lib = Library(spark, d)
    m, _ = services.tradition_search(lib.index("page_text").search(PAGE_FIELDS, "هذا على"), lib.page, lib.service, lib.book, lib.author)
    return m.withColumn("hadeeth", F.array_join(F.col("hadeeth").cast("array<string>"), ","))


def tradition_sources(spark: SparkSession, d: str) -> DataFrame:
    """Where else the keys of the matching pages stand."""
    lib = Library(spark, d)
    return services.tradition_search(lib.index("page_text").search(PAGE_FIELDS, "هذا على"), lib.page, lib.service, lib.book, lib.author)[1]


def _index(spark: SparkSession, d: str) -> DataFrame:
    return postings.postings(Library(spark, d).page_text_rows, ["book_id", "page_id"], PAGE_FIELDS)


def postings_search(spark: SparkSession, d: str) -> DataFrame:
    """The search for two words over an index made in the query itself."""
    return postings.search(_index(spark, d), ["book_id", "page_id"], PAGE_FIELDS, "هذا على").withColumn("matched_in", F.array_join("matched_in", ","))


def postings_phrase(spark: SparkSession, d: str) -> DataFrame:
    """A phrase over the saved index of words."""
    words = arabic.fold_query("من هذا")
    rows = Library(spark, d).index("page_text").rows(postings.WORDS, words, PAGE_FIELDS)
    return postings.in_order(rows, ["book_id", "page_id"], PAGE_FIELDS, words).withColumn("matched_in", F.array_join("matched_in", ","))


def search_books_full(spark: SparkSession, d: str) -> DataFrame:
    """Books whose name, authors (co-authors too) or bibliography hold the word."""
    lib = Library(spark, d)
    return search.search(catalog.searchable_books(lib.book, lib.author), ["book_name", "all_authors", "bibliography"], "أبو").select("book_id", _fields())


def search_authors_full(spark: SparkSession, d: str) -> DataFrame:
    """Authors whose name or biography holds the word."""
    return search.search(Library(spark, d).author, ["author_name", "death_text"], "ت").select("author_id", _fields())


#: Keys that some queries ask for: books, pages and titles that may or may not exist.
ASKED = [(b, p) for b in (3, 1, 2, 999_999) for p in (2, 1, 5000)]


def fetched_pages(spark: SparkSession, d: str) -> DataFrame:
    """Asked pages in the asked order, found or not, with their texts."""
    lib = Library(spark, d)
    return pages.fetch(lib.page, lib.page_text, ASKED)


def fetched_titles(spark: SparkSession, d: str) -> DataFrame:
    """The texts of asked titles in the asked order."""
    return pages.fetch_titles(Library(spark, d).title, ASKED)


def verse_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The verse table: running number, sura, verse in the sura."""
    return verses.aya_dim(spark).select("aya_id", "surah", "surah_name", "aya")


def _asked_books(lib: Library) -> list[int]:
    """Books to ask a verse of: those with most of its entries in another order than the books', some without any, one unknown."""
    b = lib.service.where((F.col("service_name") == "tafseer") & F.col("book_id").isNotNull()).groupBy("book_id").agg(F.count_if(F.col("key_id") == AYA).alias("n")).orderBy(F.desc("n"), F.desc("book_id")).limit(6)
    return [*[r.book_id for r in b.collect()], -1]


def verse_texts_asked(spark: SparkSession, d: str) -> DataFrame:
    """Passages of one verse in asked books, in the asked order, two at most."""
    lib = Library(spark, d)
    return services.verse_texts(lib.service, lib.book, lib.author, lib.page_text, AYA, 2, book_ids=_asked_books(lib)).select("place", "book_id", "page_id", "n_chars", "status")


def source_status(spark: SparkSession, d: str) -> DataFrame:
    """For asked books whether they treat one verse, are indexed, are downloaded."""
    lib = Library(spark, d)
    return services.source_status(lib.service, lib.book, AYA, _asked_books(lib))


QUERIES = {
    f.__name__: f
    for f in (
        search_pages, search_pages_scoped, search_pages_window, search_pages_coverage, search_pages_wildcard, search_pages_snippets, search_titles, search_books, search_books_rollup, search_authors, search_phrase, search_near,
        search_exact, search_exact_snippets, search_exact_flags, search_boolean, search_boolean_report, root_stats, resolve_names, search_verses, page_cards, page_parts, page_chains, page_services, page_ranges, toc, book_sections,
        book_parts, book_cards, book_authors, author_cards, list_categories, downloaded_books, downloaded_tally, books_by_period, scope_books, scope_diagnostics, library_health, citations, verse_entries, tradition_entries,
        verse_coverage, verse_coverage_totals, verse_texts, tradition_matches, tradition_sources, postings_search, postings_phrase, search_books_full, search_authors_full, fetched_pages, fetched_titles, verse_numbers,
        verse_texts_asked, source_status,
    )
}
from quire.plans.reference_sql import ORACLE  # noqa: E402, F401
