"""What the plans must and must not hold."""

import re

import pytest

from quire.plans import data_queries, reference_queries
from quire.sources.tables import Library

PYTHON = re.compile("MapInArrow|ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroups")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["search_pages", "search_phrase", "search_near", "search_exact", "search_boolean", "root_stats", "toc", "book_sections", "page_cards", "citations", "books_by_period", "verse_entries", "author_cards", "scope_books", "postings_search"])
def test_built_ins_only(spark, sf_dir, name):
    assert not PYTHON.search(plan(reference_queries.QUERIES[name](spark, sf_dir)))


@pytest.mark.parametrize("name", sorted(reference_queries.QUERIES))
def test_no_cross_joins(spark, sf_dir, name):
    text = plan(reference_queries.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p2_hits_per_book", "p5_found", "p5_report"])
def test_no_cross_joins_in_data_queries(spark, sf_dir, name):
    text = plan(data_queries.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_only_asked_columns_are_read(spark, sf_dir):
    lib = Library(spark, sf_dir)
    schema = re.findall(r"ReadSchema: struct<(\S*)>", plan(lib.page_text_rows.where("comment is not null").select("book_id", "comment")))
    assert schema and all("body" not in s for s in schema)
    hits = plan(reference_queries.search_pages_scoped(spark, sf_dir))
    assert all("comment" not in s for s in re.findall(r"ReadSchema: struct<(\S*)>", hits)) and "LeftSemi" in hits


def test_filters_reach_the_scan(spark, sf_dir):
    text = plan(reference_queries.tradition_entries(spark, sf_dir))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(service_name,hadeeth\)", text)
    assert re.search(r"PushedFilters: \[[^\]]*IsNull\(deleted_at\)", text)


def test_windows_of_results_are_top_k(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(reference_queries.search_pages_window(spark, sf_dir))


def test_text_is_not_shuffled_by_a_search(spark, sf_dir):
    """Only the hits' keys are exchanged, unless a small file is spread over idle cores first."""
    lib = Library(spark, sf_dir)
    from quire.operators import search

    text = plan(search.search(lib._raw("page_text"), ["body"], "هذا").select("book_id", "page_id").distinct())
    below = text.split("Exchange", 1)[1]
    assert "Exchange" not in below and "body" not in text.split("Exchange", 1)[0]


@pytest.mark.parametrize("name", ["search_pages", "search_pages_scoped", "search_pages_coverage", "search_phrase", "search_near", "search_boolean", "search_boolean_report", "tradition_sources"])
def test_searches_read_buckets_and_no_text(spark, sf_dir, name):
    """The saved index is pruned by the terms' buckets; no scan reads a text."""
    text = plan(reference_queries.QUERIES[name](spark, sf_dir))
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (?:IN|=|INSET)", text) and re.search(r"PushedFilters: \[[^\]]*(?:In|EqualTo)\(token", text)
    assert not any("body" in s or "foot" in s for s in re.findall(r"ReadSchema: struct<(\S*)>", text))


def test_sizes_move_instead_of_texts(spark, sf_dir):
    """Page texts are read for their lengths; nothing but keys and numbers is exchanged."""
    for name in ("page_cards", "page_ranges"):
        text = reference_queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "first(struct" not in text and not re.search(r"Aggregate \[[^\n]*body#\d+[,\]][^\n]*\n", text)
