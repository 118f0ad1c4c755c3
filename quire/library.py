"""The library's tools as one object: typed arguments in, rendered pages of results out.

Each tool validates its arguments, builds a DataFrame with the operators, and writes the keys of its hits once:
the total, the window that is shown and the roll-ups are read from that small table, and text is read for the
window alone. The tables of a call are dropped when it ends. Every tool takes response_format, json or markdown.
With a saved index the term, boolean, phrase and proximity searches read no text but that of the window; without
one they scan. For analysis over everything use the operators themselves.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import render
from quire.errors import LibraryError, empty_scope
from quire.functions import arabic, verses
from quire.functions.snippets import exact_snippet_column, snippet_column, split_parts
from quire.operators import catalog, pages, search, services
from quire.operators import scope as scopes
from quire.operators.citation import AUTO_NUMBERED, default_style, full_style, missing_parts, short_style
from quire.operators.postings import Index
from quire.runtime import dropping, materialize
from quire.sources import tables
from quire.sources.tables import Library as Tables

GUIDE = {
    "start": "search_pages finds text; get_toc, get_page and get_book_section read it; get_citation refers to it.",
    "scope": "A scope intersects book_ids, author_ids, category_ids, a period and downloaded_only; within one source values are united.",
    "search": "Terms are joined by AND, each may stand in any searched field; wildcards * and ?; phrase, near, exact and boolean search have tools of their own.",
    "services": "Keys link verses and traditions to pages: get_tafseer_of_aya, list_tafsirs_for_aya, get_tafseer_texts, get_books_for_hadith, search_hadith.",
}


#: Fields of page texts, and the keys of a page.
TEXT_FIELDS = ("body", "foot", "comment")
PAGE = ["book_id", "page_id"]


def _tool(f: Callable) -> Callable:
    @wraps(f)
    def call(self: Toolbox, *args: object, response_format: str | None = None, **kwargs: object):  # noqa: ANN202
        if response_format not in (None, "json", "markdown"):
            raise LibraryError("BAD_ARG", "response_format is json or markdown")
        with dropping(), render.formatted(response_format or render.current()):
            return f(self, *args, **kwargs)

    return call


def _tools(cls: type) -> type:
    for name, f in list(vars(cls).items()):
        if inspect.isfunction(f) and not name.startswith("_") and name != "build_index":
            setattr(cls, name, _tool(f))
    return cls


@_tools
@dataclass
class Toolbox:
    """index: the path of a saved index of the page texts, see build_index()."""

    spark: SparkSession
    folder: str
    index: str | None = None

    def __post_init__(self) -> None:
        self.t = Tables(self.spark, self.folder)

    def build_index(self, path: str) -> Toolbox:
        """Writes the index of the page texts below the path; the result is this box over it."""
        Index.build(self.t.page_text_rows, PAGE, list(TEXT_FIELDS), path)
        return Toolbox(self.spark, self.folder, path)

    # --- search ----------------------------------------------------------------------------------

    def _scoped(self, df: DataFrame, scope: scopes.Scope | None) -> DataFrame:
        if scope is None:
            return df
        sizes = [(r.source, r.contributed) for r in scopes.diagnostics(scope, self.t.book, self.t.author).collect()]
        if sizes and sizes[-1][1] == 0:
            raise empty_scope(sizes)
        return scopes.within(df, scope, self.t.book, self.t.author)

    def _page(self, hits: DataFrame, order: list, limit: int, offset: int, **more: object) -> dict:
        total = hits.count()
        shown = [r.asDict(recursive=True) for r in search.paginate(hits, order, limit, offset).collect()]
        return search.envelope(total, len(shown), offset) | more | {"results": shown}

    @staticmethod
    def _fields(search_in: tuple[str, ...]) -> list[str]:
        return [f for f in dict.fromkeys(search_in) if f in TEXT_FIELDS] or ["body", "foot"]

    def _open(self) -> Index | None:
        return Index.open(self.spark, self.index, PAGE, list(TEXT_FIELDS)) if getattr(self, "index", None) else None

    def _kept(self, hits: DataFrame, *columns: str) -> DataFrame:
        """The hits' keys and columns, once per page, written: everything else is read from it."""
        return materialize(hits.select(*PAGE, *columns).dropDuplicates(PAGE), "hits")

    def _pages(self, kept: DataFrame, limit: int, offset: int, snippets: dict[str, Column], **more: object) -> dict:
        """The window of page hits with book, author, category, label and excerpts; text is read by the window's keys."""
        out = self._page(kept, PAGE, limit, offset, **more)
        if not out["results"]:
            return out
        window = self.spark.createDataFrame([tuple(r.values()) for r in out["results"]], kept.schema)
        books = sorted({r["book_id"] for r in out["results"]})
        own = lambda df: df.where(F.col("book_id").isin(books) & F.col("page_id").isin(sorted({r["page_id"] for r in out["results"]})))
        text = own(self.t.page_text_rows).dropDuplicates(PAGE).select(*PAGE, *[c.alias(n) for n, c in snippets.items()])
        rows = search.enrich(window, self.t.book.where(F.col("book_id").isin(books)), self.t.author, own(self.t.page)).join(text, PAGE, "left")
        return out | {"results": render.rows(rows.orderBy(*PAGE))}

    def search_pages(self, query: str, scope: scopes.Scope | None = None, search_in: tuple[str, ...] = ("body", "foot"), limit: int = 20, offset: int = 0, **options: bool) -> dict:
        fields, terms, index = self._fields(search_in), arabic.fold_query(query), self._open()
        search.check_options(**options)
        if index:
            hits = self._scoped(index.matching(fields, query, **options) if any(options.values()) else index.search(fields, query), scope)
        else:
            hits = search.search(self._scoped(self.t.page_text_rows, scope), fields, query, **options)
        kept = self._kept(hits, "matched_in")
        spread = search.coverage(search.hits_per_book(kept), self.t.book, self.t.author)
        return render.render(self._pages(kept, limit, offset, {f"snippet_{f}": snippet_column(F.col(f), terms) for f in fields}, query=query, normalized_tokens=terms, coverage=render.rows(spread)))

    def search_titles(self, query: str, scope: scopes.Scope | None = None, limit: int = 20, offset: int = 0, **options: bool) -> dict:
        hits = search.search(self._scoped(self.t.title, scope), ["body"], query, **options)
        kept = materialize(hits.select("book_id", F.col("id").alias("title_id"), "page", F.col("parent").alias("parent_id"), "body"), "titles")
        return render.render(self._page(search.enrich(kept, self.t.book, self.t.author), ["book_id", "title_id"], limit, offset, query=query))

    def search_books(self, query: str, scope: scopes.Scope | None = None, limit: int = 20, offset: int = 0, **options: bool) -> dict:
        """Over names, all authors and the bibliography."""
        if scope is not None and scope.book_ids:
            raise LibraryError("BAD_ARG", "a book search has no book_ids in its scope")
        rows = catalog.searchable_books(self._scoped(self.t.book, scope), self.t.author)
        hits = search.search(rows, ["book_name", "all_authors", "bibliography"], query, **options)
        kept = materialize(hits.select("book_id", "book_name", "author_name", "book_category", "book_date", "matched_in"), "books")
        return render.render(self._page(kept, ["book_id"], limit, offset, query=query))

    def search_authors(self, query: str, limit: int = 20, offset: int = 0, **options: bool) -> dict:
        """Over names and biographies."""
        found = search.search(self.t.author, ["author_name", "death_text"], query, **options).select("author_id", "matched_in")
        kept = materialize(found, "authors")
        cards = catalog.author_cards(self.t.book, self.t.author).select("author_id", "author_name", "death_year", "book_count")
        return render.render(self._page(kept.join(cards, "author_id"), ["author_id"], limit, offset, query=query))

    def search_phrase(self, query: str, mode: str = "phrase", distance: int = 10, scope: scopes.Scope | None = None, search_in: tuple[str, ...] = ("body", "foot"), limit: int = 20, offset: int = 0) -> dict:
        fields, index = self._fields(search_in), self._open()
        search.check_mode(mode, distance)
        if index:
            hits = self._scoped(index.phrase(fields, query) if mode == "phrase" else index.near(fields, query, distance), scope)
        else:
            hits = search.search_phrase(self._scoped(self.t.page_text_rows, scope), fields, query, mode, distance)
        terms = arabic.fold_query(query)
        return render.render(self._pages(self._kept(hits, "matched_in"), limit, offset, {f"snippet_{f}": snippet_column(F.col(f), terms) for f in fields}, query=query, mode=mode))

    def search_exact(self, query: str, scope: scopes.Scope | None = None, search_in: tuple[str, ...] = ("body", "foot"), limit: int = 20, offset: int = 0, **preserve: bool) -> dict:
        fields = self._fields(search_in)
        hits = search.search_exact(self._scoped(self.t.page_text_rows, scope), fields, query, **preserve)
        needle = arabic.fold_exact(query, **preserve)
        return render.render(self._pages(self._kept(hits, "matched_in"), limit, offset, {f"snippet_{f}": exact_snippet_column(F.col(f), needle, **preserve) for f in fields}, query=query))

    def search_boolean(self, all_of: list[str] = (), any_of: list[str] = (), none_of: list[str] = (), scope: scopes.Scope | None = None, search_in: tuple[str, ...] = ("body", "foot"), limit: int = 20, offset: int = 0) -> dict:
        fields, index, queries = self._fields(search_in), self._open(), [*all_of, *any_of, *none_of]
        if index and any(arabic.fold_query(q) for q in [*all_of, *any_of]):
            hits = self._scoped(index.boolean(fields, list(all_of), list(any_of), list(none_of)), scope)
            report = index.report(fields, queries) if scope is None else search.term_report(self._scoped(self.t.page_text_rows, scope), fields, queries, PAGE)
        else:
            rows = self._scoped(self.t.page_text_rows, scope)
            hits = search.search_boolean(rows, fields, list(all_of), list(any_of), list(none_of))
            report = search.term_report(rows, fields, queries, PAGE)
        terms = [t for q in [*all_of, *any_of] for t in arabic.fold_query(q)]
        return render.render(self._pages(self._kept(hits, "matched_terms"), limit, offset, {f"snippet_{f}": snippet_column(F.col(f), terms) for f in fields}, subqueries=render.rows(report)))

    def search_quran(self, verse_table: DataFrame, query: str, wildcards: bool = False, limit: int = 20, offset: int = 0) -> dict:
        """verse_table: id, body."""
        return render.render(self._page(search.verse_search(verse_table, "body", "id", query, wildcards), ["id"], limit, offset, query=query))

    def search_hadith(self, query: str, limit: int = 20, offset: int = 0, takhrij_limit: int = 100, takhrij_offset: int = 0) -> dict:
        """Two windows: the matching pages, and the entries of all their keys (takhrij, its envelope in takhrij_window)."""
        index = self._open()
        kept = self._kept(index.search(["body", "foot"], query) if index else search.search(self.t.page_text_rows, ["body", "foot"], query))
        matches, where = services.tradition_search(kept, self.t.page, self.t.service, self.t.book, self.t.author)
        takhrij = self._page(where, ["key_id", "book_id", "page_id"], takhrij_limit, takhrij_offset)
        return render.render(self._page(matches, ["book_id", "page_id"], limit, offset, query=query, takhrij=takhrij.pop("results"), takhrij_window=takhrij))

    def root_stats(self, root: str, scope: scopes.Scope | None = None) -> dict:
        index = self._open()
        if index:
            spread = search.coverage(search.hits_per_book(self._scoped(index.matching(["body", "foot"], root, morphology=True), scope)), self.t.book, self.t.author, 15)
        else:
            spread = search.root_stats(self._scoped(self.t.page_text_rows, scope), ["body", "foot"], root, self.t.book, self.t.author)
        return render.render({"root": root, "note": "stems are approximate", "distribution": render.rows(spread)})

    def resolve(self, query: str, kind: str = "any", limit: int = 10) -> dict:
        if kind not in ("any", "book", "author"):
            raise LibraryError("BAD_ARG", "kind is any, book or author")
        out: dict = {"query": query, "books": [], "authors": []}
        if kind != "author":
            out["books"] = render.rows(search.autocomplete(self.t.book, "book_id", "book_name", query, "book", limit))
        if kind != "book":
            out["authors"] = render.rows(search.autocomplete(self.t.author, "author_id", "author_name", query, "author", limit))
        return render.render(out)

    # --- books and pages -------------------------------------------------------------------------

    def _one(self, df: DataFrame, code: str, what: str) -> dict:
        row = df.first()
        if row is None:
            raise LibraryError(code, what)
        return row.asDict(recursive=True)

    def _readable_book(self, book_id: int) -> DataFrame:
        row = self._one(self.t.book.where(F.col("book_id") == book_id), "BOOK_NOT_FOUND", f"book {book_id}")
        if not row["downloaded"]:
            raise LibraryError("BOOK_NOT_DOWNLOADED", f"book {book_id}")
        return self.t.page.where(F.col("book_id") == book_id)

    def get_book(self, book_id: int) -> dict:
        own = lambda df: df.where(F.col("book_id") == book_id)
        card = self._one(catalog.book_cards(own(self.t.book), self.t.author, own(self.t.page), own(self.t.page_text)), "BOOK_NOT_FOUND", f"book {book_id}")
        card["authors"] = render.rows(catalog.ordered_authors(own(self.t.book), self.t.author).orderBy("position"))
        return render.render(card)

    def get_author(self, author_id: int, include_books: bool = True) -> dict:
        card = self._one(catalog.author_cards(self.t.book, self.t.author).where(F.col("author_id") == author_id), "AUTHOR_NOT_FOUND", f"author {author_id}")
        return render.render(card if include_books else {k: v for k, v in card.items() if k != "book_ids"})

    def get_page(self, book_id: int, page_id: int, keep_html: bool = False, body_part: int = 1) -> dict:
        own = self._readable_book(book_id)
        only = F.col("book_id") == book_id, F.col("page_id") == page_id
        label = own.where(only[1]).select(arabic.clean_part(F.col("part")).alias("part"), arabic.printed_label(F.col("part"), F.col("page")).alias("printed_page"))
        card = {"book_id": book_id, "page_id": page_id} | self._one(label, "PAGE_NOT_FOUND", f"page {page_id} of book {book_id}")
        body = F.coalesce("body", F.lit(""))
        text = self.t.page_text_rows.where(only[0] & only[1]).select((body if keep_html else arabic.plain_text(body)).alias("text"), F.coalesce("foot", F.lit("")).alias("foot")).first()
        before, after = pages.neighbours_of(own, page_id)
        title = self.t.title.where(only[0])
        cut = split_parts(text.text if text else "", pages.PART_BUDGET)
        at = min(max(1, body_part), len(cut))
        card |= {"prev_page_id": before, "next_page_id": after, "text": cut[at - 1], "foot": text.foot if text and at == 1 else "", "part_of_text": at, "total_parts": len(cut), "has_more": at < len(cut)}
        return render.render(card | {"titles": pages.chain_of(title, pages.owner_of(title, page_id))})

    def get_pages_range(self, book_id: int, start_page_id: int, count: int = 5) -> dict:
        own, text = self._readable_book(book_id), self.t.page_text_rows.where(F.col("book_id") == book_id)
        kept = [r.page_id for r in pages.page_range(own, text, start_page_id, count).select("page_id").collect()]  # at most 20
        return render.render({"pages": self._read(book_id, own, kept)})

    def _read(self, book_id: int, own: DataFrame, ids: list[int]) -> list[dict]:
        """A few pages of a book in order, with label and displayed text."""
        body = arabic.plain_text(F.coalesce("body", F.lit(""))).alias("text")
        text = self.t.page_text_rows.where((F.col("book_id") == book_id) & F.col("page_id").isin(ids)).dropDuplicates(PAGE).select("page_id", body, F.coalesce("foot", F.lit("")).alias("foot"))
        label = own.where(F.col("page_id").isin(ids)).select("page_id", arabic.clean_part(F.col("part")).alias("part"), arabic.printed_label(F.col("part"), F.col("page")).alias("printed_page"))
        return render.rows(label.join(text, "page_id", "left").fillna("", ["text", "foot"]).orderBy("page_id"))

    def get_book_section(self, book_id: int, title_id: int, max_pages: int = 20) -> dict:
        """The pages of a title, at most max_pages and RANGE_BUDGET characters of them; next_start_page_id tells where to read on."""
        if not 1 <= max_pages <= 100:
            raise LibraryError("BAD_ARG", "max_pages 1 to 100")
        own = self._readable_book(book_id)
        part = self._one(pages.sections(self.t.title.where(F.col("book_id") == book_id), own).where(F.col("title_id") == title_id), "TITLE_NOT_FOUND", f"title {title_id} of book {book_id}")
        ids = [r.page_id for r in own.where(F.col("page_id").between(part["start_page_id"], part["end_page_id"])).select("page_id").orderBy("page_id").limit(max_pages).collect()]
        read = self._read(book_id, own, ids)
        shown = read[: pages.within_budget([len(r["text"]) + len(r["foot"]) for r in read])]
        last = shown[-1]["page_id"] if shown else part["start_page_id"] - 1
        more = last < part["end_page_id"]
        cut = len(shown) < part["total_pages"]
        notice = f"{len(shown)} of {part['total_pages']} pages, " + (f"the limit is {pages.RANGE_BUDGET} characters" if len(shown) < len(read) else f"the limit is {max_pages} pages") if cut else None
        return render.render(part | {"truncated": cut, "next_start_page_id": last + 1 if more else None, "notice": notice, "pages": shown})

    def get_toc(self, book_id: int, parent_id: int = 0, depth: int = 1, containing_page_id: int | None = None) -> dict:
        """The titles below a parent; with containing_page_id the chain of titles from the root to the one that holds the page."""
        self._readable_book(book_id)
        title = self.t.title.where(F.col("book_id") == book_id)
        if containing_page_id is None:
            return render.render({"mode": "subtree", "titles": render.rows(pages.toc(title, parent_id, depth).orderBy("level", "title_id")), "ancestor_chain": []})
        chain = pages.chain_of(title, pages.owner_of(title, containing_page_id)) or []
        rows = {r["title_id"]: r for r in render.rows(title.where(F.col("id").isin(chain)).select(F.col("id").alias("title_id"), "page", "parent", "body"))} if chain else {}
        return render.render({"mode": "ancestor_chain", "titles": [], "ancestor_chain": [rows[i] for i in chain]})

    def get_book_parts(self, book_id: int) -> dict:
        found = render.rows(pages.parts(self._readable_book(book_id)).orderBy("first_page_id"))
        return render.render({"is_multi_volume": bool(found), "parts": found})

    def get_page_services(self, book_id: int, page_id: int) -> dict:
        one = pages.annotations(self.t.page.where((F.col("book_id") == book_id) & (F.col("page_id") == page_id))).first()
        return render.render(one.asDict() if one else {"book_id": book_id, "page_id": page_id, "valid": None, "ayat": [], "hadeeth": [], "esnad": []})

    def get_citation(self, book_id: int, page_id: int | None = None, text: str | None = None, style: str = "default", auto_note: str = AUTO_NUMBERED) -> dict:
        styles = {"default": default_style(F.lit(text), auto_note), "short": short_style(), "full": full_style(auto_note)}
        if style not in styles:
            raise LibraryError("BAD_ARG", f"style is one of {', '.join(styles)}")
        row = catalog.with_main_author(self.t.book.where(F.col("book_id") == book_id), self.t.author)
        page = self.t.page.where((F.col("book_id") == book_id) & (F.col("page_id") == (page_id or 0))).select("book_id", arabic.clean_part(F.col("part")).alias("part"), "page")
        rows = row.join(page, "book_id", "left").select(styles[style].alias("formatted"), missing_parts().alias("notes"))
        return render.render(self._one(rows, "BOOK_NOT_FOUND", f"book {book_id}"))

    # --- catalogue -------------------------------------------------------------------------------

    def list_categories(self, names: DataFrame | None = None, downloaded_only: bool = False) -> dict:
        return render.render({"categories": [r.asDict() for r in catalog.categories(self.t.book, names, downloaded_only).collect()]})

    def list_downloaded_books(self, category_id: int | None = None, limit: int = 20, offset: int = 0) -> dict:
        tally = [r.asDict() for r in catalog.library_tally(self.t.book).collect()]
        return render.render(self._page(catalog.downloaded_books(self.t.book, self.t.page, category_id), ["book_id"], limit, offset, by_category=tally))

    def books_by_period(self, limit: int = 20, offset: int = 0, **bounds: object) -> dict:
        return render.render(self._page(catalog.by_period(self.t.book, self.t.author, **bounds), ["book_id"], limit, offset))

    def health(self) -> dict:
        return render.render(catalog.health(self.t.book, self.t.author, self.t.page).first().asDict())

    # --- keys ------------------------------------------------------------------------------------

    @staticmethod
    def _aya(aya_id: int | None, surah: int | None, aya: int | None) -> int:
        number = aya_id if aya_id is not None else verses.aya_id(surah, aya) if surah and aya else None
        if aya_id is None and not (surah and aya):
            raise LibraryError("BAD_ARG", "give aya_id, or surah and aya")
        if number is None or verses.sura_and_verse(number) is None:
            raise LibraryError("AYA_NOT_FOUND", str(aya_id or (surah, aya)))
        return number

    def get_aya(self, verse_table: DataFrame | None = None, aya_id: int | None = None, surah: int | None = None, aya: int | None = None) -> dict:
        """verse_table: id and the orthographies."""
        number = self._aya(aya_id, surah, aya)
        s, v = verses.sura_and_verse(number)
        text = self._one(verse_table.where(F.col("id") == number), "AYA_NOT_FOUND", str(number)) if verse_table is not None else {}
        return render.render({"aya_id": number, "surah": s, "surah_name": verses.NAMES[s - 1], "aya": v} | text)

    def _entries(self, name: str, key: int, downloaded_only: bool) -> dict:
        rows = services.entries(self.t.service, name, self.t.book, self.t.author).where(F.col("key_id") == key)
        kept = rows.where("downloaded") if downloaded_only else rows
        total = rows.count()
        if not total:
            raise LibraryError("SERVICE_KEY_NOT_FOUND", f"no book is indexed under key {key} of {name}", {"service": name, "key": key})
        found = render.rows(kept.orderBy("page_id", "book_id"))  # all entries of one key
        return render.render({"key": key, "total": total, "returned": len(found), "entries": found})

    def get_tafseer_of_aya(self, downloaded_only: bool = True, **which: int) -> dict:
        return self._entries("tafseer", self._aya(which.get("aya_id"), which.get("surah"), which.get("aya")), downloaded_only)

    def get_books_for_hadith(self, hadith_key: int, downloaded_only: bool = True) -> dict:
        return self._entries("hadeeth", hadith_key, downloaded_only)

    def list_tafsirs_for_aya(self, **which: int) -> dict:
        number = self._aya(which.get("aya_id"), which.get("surah"), which.get("aya"))
        found = [r.asDict() for r in services.verse_coverage(self.t.service, self.t.book, self.t.author, number).collect()]
        return render.render({"aya_id": number, "totals": {s: sum(r["status"] == s for r in found) for s in services.STATUS}, "books": found})

    def get_tafseer_texts(self, book_ids: list[int] | None = None, max_sources: int = 5, **which: int) -> dict:
        number = self._aya(which.get("aya_id"), which.get("surah"), which.get("aya"))
        status = [r.asDict() for r in services.source_status(self.t.service, self.t.book, number, book_ids).collect()] if book_ids else []
        rows = services.verse_texts(self.t.service, self.t.book, self.t.author, self.t.page_text, number, max_sources, book_ids=book_ids)
        found = render.rows(rows.orderBy("place"))
        return render.render({"aya_id": number, "asked": status, "sources": [r for r in found if r["status"] == "ok"], "remaining_book_ids": [r["book_id"] for r in found if r["status"] != "ok"]})

    def resource(self, name: str) -> dict | str:
        """categories, downloaded (the tally of all), guide, schema or status."""
        if name == "categories":
            return self.list_categories()
        if name == "downloaded":
            return render.render({"by_category": [r.asDict() for r in catalog.library_tally(self.t.book).collect()]})
        if name == "schema":
            return render.render({"book": tables.BOOK, "author": tables.AUTHOR, "category": tables.CATEGORY, "page": tables.PAGE, "page_text": tables.PAGE_TEXT, "title": tables.TITLE, "service": tables.SERVICE})
        if name == "status":
            return self.health()
        if name == "guide":
            return self.guide()
        raise LibraryError("BAD_ARG", "no such resource")

    def guide(self, section: str = "start") -> str:
        return GUIDE.get(section, GUIDE["start"])
