"""The data-processing queries p1, p2, p5 and p6 over the driver's tables, with their SQL."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.forest import descendants, last_rows, resolve_forest
from quire.operators.orphans import Reference, Target, orphan_report, orphans
from quire.operators.packed import split_packed
from quire.operators.tree_agg import heavy_keys, tree_aggregate, tree_distinct_count
from quire.runtime import table


#: The decimal digits of every script but ASCII, and the ASCII digit of each.
_DIGITS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isdecimal())
_ASCII = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every entry of book.authors_csv and book.pdf_links."""
    names = table(spark, d, "author").select("author_name")
    return split_packed(table(spark, d, "book"), ["book_id"], ["authors_csv", "pdf_links"], names).select("book_id", "field", "pos", "item").distinct()


def p1_author_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of authors_csv as author ids (the decimal digits of any script: Arabic-Indic, Persian, full-width, Devanagari and so on), with the number of books that name each."""
    e = p1_found(spark, d).where("field = 'authors_csv'")
    ids = e.withColumn("author_id", F.translate("item", _DIGITS, _ASCII)).where(F.col("author_id").rlike("^[0-9]+$"))
    return ids.groupBy(F.col("author_id").cast("int").alias("author_id")).agg(F.count_distinct("book_id").alias("n_books"), F.min("pos").alias("first_pos"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys of search_hit.book_id and page.page_id that more than 4 % of the stored rows hold."""
    one = lambda t, k: heavy_keys(table(spark, d, t), k, 4).select(F.lit(t).alias("tbl"), F.col("key").cast("int").alias("key_id"))
    return one("search_hit", "book_id").unionByName(one("page", "page_id"))


def p2_hits_per_book(spark: SparkSession, d: str) -> DataFrame:
    """Per book: stored hits, hits with a label, best and worst rank, first and last hit, searches."""
    hits, key = table(spark, d, "search_hit"), {"book_id": F.col("book_id")}
    rows = hits.count()
    stats = tree_aggregate(
        hits,
        key,
        {"n_hits": ("count", F.lit(1)), "n_labels": ("count", F.col("printed_page")), "best_rank": ("min", F.col("rank_no")), "worst_rank": ("max", F.col("rank_no")), "first_hit": ("min", F.col("hit_at")), "last_hit": ("max", F.col("hit_at"))},
        rows=rows,
    )
    runs = tree_distinct_count(hits, key, F.col("run_id"), "n_runs", rows=rows).withColumnRenamed("book_id", "b")
    return stats.join(runs, F.col("book_id").eqNullSafe(F.col("b")), "left").drop("b").withColumn("n_runs", F.coalesce("n_runs", F.lit(0).cast("long")))


def p2_pages_per_number(spark: SparkSession, d: str) -> DataFrame:
    """Per page number: stored rows, rows withdrawn, smallest and largest printed number."""
    return tree_aggregate(
        table(spark, d, "page"),
        {"page_id": F.col("page_id")},
        {"n_rows": ("count", F.lit(1)), "n_withdrawn": ("count", F.col("deleted_at")), "min_number": ("min", F.col("number")), "max_number": ("max", F.col("number"))},
    )


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    service, book, page, author = (table(spark, d, t) for t in ("service", "book", "page", "author"))
    refs = [
        Reference("service", "book_id", "book", service.where("service_name = 'hadeeth'"), F.col("hit_id"), [F.col("book_id")], F.col("loaded_at")),
        Reference("service", "page_id", "page", service.where("service_name = 'tafseer'"), F.col("hit_id"), [F.col("book_id"), F.col("page_id")], F.col("loaded_at")),
        Reference("book", "main_author", "author", book.where("main_author <> 0"), F.col("book_id"), [F.col("main_author")], F.col("loaded_at")),
    ]
    live = F.col("deleted_at").isNull()
    targets = [
        Target("book", book, [F.col("book_id")], live, F.col("loaded_at")),
        Target("page", page, [F.col("book_id"), F.col("page_id")], live, F.col("loaded_at")),
        Target("author", author, [F.col("author_id")], live, F.col("loaded_at")),
    ]
    return orphans(refs, targets)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that refer to an absent, withdrawn or later book, page or author."""
    return _orphans(spark, d).select("tbl", "field", "rec_id").distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan records and missing keys per table, field and month."""
    return orphan_report(_orphans(spark, d))


def _forest(spark: SparkSession, d: str) -> DataFrame:
    return resolve_forest(last_rows(table(spark, d, "title"), "book_id", "id", "parent", "loaded_at"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Titles that stand in a loop of parents or below one."""
    return _forest(spark, d).where("in_loop").select(F.col("grp").cast("int").alias("book_id"), F.col("id").cast("int").alias("title_id"))


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every title with its root, depth and path (ids from the root, joined by /); null where in a loop."""
    return _forest(spark, d).select(
        F.col("grp").cast("int").alias("book_id"), F.col("id").cast("int").alias("title_id"), "in_loop", F.col("root").cast("int").alias("root_id"), "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path")
    )


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of a title and a title below it, with their distance."""
    return descendants(_forest(spark, d)).select(F.col("grp").cast("int").alias("book_id"), F.col("ancestor").cast("int").alias("ancestor_id"), F.col("descendant").cast("int").alias("descendant_id"), "distance")


QUERIES = {f.__name__: f for f in (p1_found, p1_author_entries, p2_found, p2_hits_per_book, p2_pages_per_number, p5_found, p5_report, p6_found, p6_paths, p6_descendants)}

_P1 = r"""f as (select distinct book_id, 'authors_csv' as field, authors_csv as v from book union select distinct book_id, 'pdf_links', pdf_links from book),
 s as (select book_id, field, v as whole, case when trim(v, E' \t\r\n') like '[%]' then substr(trim(v, E' \t\r\n'), 2, length(trim(v, E' \t\r\n')) - 2) else v end as v from f where v is not null),
 t as (select book_id, field, whole, regexp_extract_all(v, case when field = 'authors_csv' then '"(?:[^"]|"")*"|“[^”]*”|«[^»]*»|''[^'']*''|[^,;،؛|/&\t\r\n"“«'']+' else '"(?:[^"]|"")*"|“[^”]*”|«[^»]*»|''[^'']*''|[^,;،؛|\t\r\n"“«'']+' end) as l from s),
 u as (select book_id, field, whole, list_filter(list_transform(l, lambda x: trim(x)), lambda x: x <> '') as l from t),
 w as (select book_id, field, unnest(l) as x, generate_subscripts(l, 1) as pos from u),
 entries as (select distinct book_id, field, cast(pos as integer) as pos, case when left(x, 1) = '"' then replace(substr(x, 2, length(x) - 2), '""', '"') when left(x, 1) in ('“', '«', '''') then substr(x, 2, length(x) - 2) else x end as item from w)"""

_P5 = """refs as (
   select 'service' as tbl, 'book_id' as field, 'book' as target, hit_id as rec_id, cast(book_id as varchar) as key, loaded_at as loaded from service where service_name = 'hadeeth' and book_id is not null
   union all select 'service', 'page_id', 'page', hit_id, book_id || ',' || page_id, loaded_at from service where service_name = 'tafseer' and book_id is not null and page_id is not null
   union all select 'book', 'main_author', 'author', book_id, cast(main_author as varchar), loaded_at from book where main_author <> 0),
 live as (
   select 'book' as target, cast(book_id as varchar) as key, min(loaded_at) as since from book where deleted_at is null group by 1, 2
   union all select 'page', book_id || ',' || page_id, min(loaded_at) from page where deleted_at is null group by 1, 2
   union all select 'author', cast(author_id as varchar), min(loaded_at) from author where deleted_at is null group by 1, 2),
 cases as (select r.* from refs r left join live l on l.target = r.target and l.key = r.key where l.since is null or r.loaded < l.since)"""

_P6 = """recursive n as (select book_id, id, max(struct_pack(l := loaded_at, p := parent)).p as parent from title where book_id is not null and id is not null group by 1, 2),
 m as (select a.book_id, a.id, case when b.id is null or a.parent = 0 then null else a.parent end as parent from n a left join n b on a.book_id = b.book_id and a.parent = b.id),
 r as (select book_id, id, [id] as path from m where parent is null union all select m.book_id, m.id, list_append(r.path, m.id) from m join r on m.book_id = r.book_id and m.parent = r.id)"""

ORACLE = {
    "p1_found": f"with {_P1} select book_id, field, pos, item from entries",
    "p1_author_entries": f"with {_P1} select cast(translate(item, '٠١٢٣٤٥٦٧٨٩', '0123456789') as integer) as author_id, count(distinct book_id) as n_books, min(pos) as first_pos from entries where field = 'authors_csv' and regexp_full_match(translate(item, '٠١٢٣٤٥٦٧٨٩', '0123456789'), '[0-9]+') group by 1",
    "p2_found": """select 'search_hit' as tbl, book_id as key_id from search_hit where book_id is not null group by book_id having count(*) * 100 > 4 * (select count(*) from search_hit)
        union all select 'page', page_id from page where page_id is not null group by page_id having count(*) * 100 > 4 * (select count(*) from page)""",
    "p2_hits_per_book": "select book_id, count(*) as n_hits, count(printed_page) as n_labels, min(rank_no) as best_rank, max(rank_no) as worst_rank, min(hit_at) as first_hit, max(hit_at) as last_hit, count(distinct run_id) as n_runs from search_hit group by book_id",
    "p2_pages_per_number": "select page_id, count(*) as n_rows, count(deleted_at) as n_withdrawn, min(number) as min_number, max(number) as max_number from page group by page_id",
    "p5_found": f"with {_P5} select distinct tbl, field, rec_id from cases",
    "p5_report": f"with {_P5}, k as (select tbl, field, target, strftime(loaded, '%Y-%m') as month, key, count(distinct rec_id) as n from cases group by all) select tbl, field, target, month, cast(sum(n) as bigint) as n_orphans, count(*) as n_keys from k group by all",
    "p6_found": f"with {_P6} select m.book_id, m.id as title_id from m left join r on m.book_id = r.book_id and m.id = r.id where r.id is null",
    "p6_paths": f"with {_P6} select m.book_id, m.id as title_id, r.id is null as in_loop, r.path[1] as root_id, cast(len(r.path) - 1 as integer) as depth, array_to_string(r.path, '/') as path from m left join r on m.book_id = r.book_id and m.id = r.id",
    "p6_descendants": f"with {_P6}, e as (select book_id, id, len(path) as n, unnest(path) as a, generate_subscripts(path, 1) as i from r) select book_id, a as ancestor_id, id as descendant_id, cast(n - i as integer) as distance from e where i < n",
}
