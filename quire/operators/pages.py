"""Pages and their place in the book: neighbours, owning titles, sections, tables of contents, budgets, annotations.

Orders within a book are computed in ranges of page numbers and carried over from range to range, so a
book that holds a third of all pages is still many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.arabic import clean_part, plain_text, printed_label
from quire.operators.forest import CELL, resolve_forest

#: Page numbers per range.
RANGE = 1024
#: Budgets in characters of a range of pages and of one part of a long text.
RANGE_BUDGET = 12_000
PART_BUDGET = 4_000


def _adjacent(df: DataFrame, keys: list[str], order: str, value: str, previous: str, following: str) -> DataFrame:
    """Adds the value of the row before and after, by an integer order within the keys.

    Rows are ordered within ranges of RANGE; only the first and last of each range are ordered per key.
    """
    ranged = df.withColumn("range__", F.floor(F.col(order) / RANGE))
    own = Window.partitionBy(*keys, "range__").orderBy(order)
    edges = ranged.groupBy(*keys, "range__").agg(F.min_by(value, order).alias("lo__"), F.max_by(value, order).alias("hi__"))
    across = Window.partitionBy(*keys).orderBy("range__")
    edges = edges.select(*keys, "range__", F.lag("hi__").over(across).alias("before__"), F.lead("lo__").over(across).alias("after__"))
    first, last = F.row_number().over(own) == 1, F.lead(F.lit(1)).over(own).isNull()
    near = ranged.select("*", F.lag(value).over(own).alias("p__"), F.lead(value).over(own).alias("n__"), first.alias("f__"), last.alias("l__")).join(edges, [*keys, "range__"])
    out = near.withColumn(previous, F.when(F.col("f__"), F.col("before__")).otherwise(F.col("p__"))).withColumn(following, F.when(F.col("l__"), F.col("after__")).otherwise(F.col("n__")))
    return out.drop("range__", "p__", "n__", "f__", "l__", "before__", "after__")


def neighbours(page: DataFrame) -> DataFrame:
    """Adds prev_page_id and next_page_id: the nearest existing pages of the book."""
    return _adjacent(page, ["book_id"], "page_id", "page_id", "prev_page_id", "next_page_id")


def page_view(page: DataFrame, text: DataFrame) -> DataFrame:
    """Every page with label, neighbours and displayed text."""
    body = plain_text(F.coalesce("body", F.lit("")))
    return neighbours(page).join(text, ["book_id", "page_id"], "left").select("book_id", "page_id", clean_part(F.col("part")).alias("part"), printed_label(F.col("part"), F.col("page")).alias("printed_page"), "prev_page_id", "next_page_id", body.alias("text"), F.coalesce("foot", F.lit("")).alias("foot"))


def fetch(page: DataFrame, text: DataFrame, ids: list[tuple[int, int]]) -> DataFrame:
    """The asked pages in the asked order, found or not."""
    asked = page.sparkSession.createDataFrame([(i, b, p) for i, (b, p) in enumerate(ids)], "place int, book_id int, page_id int")
    known = page.select("book_id", "page_id", printed_label(F.col("part"), F.col("page")).alias("printed_page"), F.lit(True).alias("found"))
    return asked.join(known, ["book_id", "page_id"], "left").join(text, ["book_id", "page_id"], "left").withColumn("found", F.coalesce("found", F.lit(False))).orderBy("place")


def fetch_titles(title: DataFrame, ids: list[tuple[int, int]]) -> DataFrame:
    """The texts of the asked titles in the asked order; empty where there is none."""
    asked = title.sparkSession.createDataFrame([(i, b, t) for i, (b, t) in enumerate(ids)], "place int, book_id int, id int")
    return asked.join(title.select("book_id", "id", "body"), ["book_id", "id"], "left").select("place", "book_id", F.col("id").alias("title_id"), F.coalesce("body", F.lit("")).alias("body")).orderBy("place")


def owning_titles(page: DataFrame, title: DataFrame) -> DataFrame:
    """book_id, page_id, title_id: the largest title id that starts at or before the page (as-of by id)."""
    events = title.where("page is not null").select("book_id", F.col("page").alias("pos"), F.col("id"), F.lit(0).alias("kind")).unionByName(page.select("book_id", F.col("page_id").alias("pos"), F.lit(None).cast("int").alias("id"), F.lit(1).alias("kind")))
    events = events.withColumn("range__", F.floor(F.col("pos") / RANGE))
    inside = F.max("id").over(Window.partitionBy("book_id", "range__").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0))
    per_range = events.groupBy("book_id", "range__").agg(F.max("id").alias("most"))
    carried = F.max("most").over(Window.partitionBy("book_id").orderBy("range__").rowsBetween(Window.unboundedPreceding, -1))
    carry = per_range.select("book_id", "range__", carried.alias("carried"))
    return events.withColumn("inside", inside).where("kind = 1").join(carry, ["book_id", "range__"]).select("book_id", F.col("pos").alias("page_id"), F.greatest("inside", "carried").alias("title_id"))


def page_chains(page: DataFrame, title: DataFrame) -> DataFrame:
    """book_id, page_id, title_id and chain, the titles from the root to the owning one (null in a loop)."""
    resolved = resolve_forest(title.select(F.col("book_id").cast("long").alias("grp"), F.col("id").cast("long").alias("id"), F.col("parent").cast("long").alias("parent")))
    paths = resolved.select(F.col("grp").cast("int").alias("book_id"), F.col("id").cast("int").alias("title_id"), F.col("path").cast("array<int>").alias("chain"))
    return owning_titles(page, title).join(paths, ["book_id", "title_id"], "left").select("book_id", "page_id", "title_id", "chain")


def neighbours_of(page: DataFrame, page_id: int) -> tuple[int | None, int | None]:
    """The nearest existing pages before and after one page, of the pages of one book: one small aggregate."""
    p = F.col("page_id")
    r = page.agg(F.max(F.when(p < page_id, p)).alias("before"), F.min(F.when(p > page_id, p)).alias("after")).first()
    return r.before, r.after


def owner_of(title: DataFrame, page_id: int) -> int | None:
    """The largest title id of one book that starts at or before the page."""
    return title.where(F.col("page") <= page_id).agg(F.max("id").alias("id")).first().id


def chain_of(title: DataFrame, title_id: int | None, cell: int = CELL) -> list[int] | None:
    """The titles from the root to one title, of the titles of one book; null in a loop.

    Walks up on the driver, over the parents of a cell of ids at a time: at most `cell` pairs of numbers are held.
    """
    chain: list[int] = []
    held: dict[int, int | None] = {}
    seen, at, loaded = set(), title_id, None
    while at:
        if at in seen:
            return None
        if loaded != at // cell:
            loaded = at // cell
            held = {r.id: r.parent for r in title.where(F.col("id").between(loaded * cell, loaded * cell + cell - 1)).select("id", "parent").collect()}
        if at not in held:
            break  # a dangling parent: the one below is the root
        seen.add(at)
        chain.append(at)
        at = held[at]
    return chain[::-1]


def within_budget(sizes: list[int], budget: int = RANGE_BUDGET) -> int:
    """How many of the first pages fit the budget, the first always."""
    total = 0
    for n, size in enumerate(sizes):
        total += size
        if n and total > budget:
            return n
    return len(sizes)


def toc(title: DataFrame, parent_id: int = 0, depth: int = 1) -> DataFrame:
    """The titles below a parent down to a depth (1 to 5), with level and has_children; parent 0: the roots of every book."""
    if not 1 <= depth <= 5:
        raise ValueError("BAD_ARG: depth 1 to 5")
    t = title.select("book_id", "id", "page", F.coalesce("parent", F.lit(0)).alias("parent"), "body")
    kids = t.groupBy("book_id", F.col("parent").alias("id")).agg(F.lit(True).alias("has_children"))
    level = t.where(F.col("parent") == parent_id).withColumn("level", F.lit(1))
    out = level
    for n in range(2, depth + 1):
        up = level.select("book_id", F.col("id").alias("parent"))
        level = t.join(up, ["book_id", "parent"], "left_semi").withColumn("level", F.lit(n))
        out = out.unionByName(level)
    return out.join(kids, ["book_id", "id"], "left").select("book_id", F.col("id").alias("title_id"), "page", "parent", "body", "level", F.coalesce("has_children", F.lit(False)).alias("has_children"))


def sections(title: DataFrame, page: DataFrame) -> DataFrame:
    """Every title with its pages: from its own to the one before the next sibling's, or the book's last."""
    last = page.groupBy("book_id").agg(F.max("page_id").alias("last_page"))
    t = title.where("page is not null").select("book_id", "id", "page", F.coalesce("parent", F.lit(0)).alias("parent"))
    t = _adjacent(t, ["book_id", "parent"], "id", "page", "sibling_before", "next")
    end = F.greatest(F.col("page"), F.coalesce(F.col("next") - 1, "last_page", F.lit(0)))
    return t.join(last, "book_id", "left").select("book_id", F.col("id").alias("title_id"), F.col("page").alias("start_page_id"), end.alias("end_page_id"), (end - F.col("page") + 1).alias("total_pages"))


def parts(page: DataFrame) -> DataFrame:
    """Volumes of every book: pages, first and last page, without blank and placeholder labels."""
    return page.withColumn("part", clean_part(F.col("part"))).where("part is not null").groupBy("book_id", "part").agg(F.count("*").alias("page_count"), F.min("page_id").alias("first_page_id"), F.max("page_id").alias("last_page_id"))


def budget_inclusive(size: Column, window: Window, budget: int) -> Column:
    """Keep while the running total fits the budget, the first row always."""
    return (F.sum(size).over(window.rowsBetween(Window.unboundedPreceding, 0)) <= budget) | (F.row_number().over(window) == 1)


def budget_exclusive(size: Column, window: Window, budget: int) -> Column:
    """Keep while the total of the rows before is below the budget, the first row always."""
    return (F.coalesce(F.sum(size).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) < budget) | (F.row_number().over(window) == 1)


def page_range(page: DataFrame, text: DataFrame, start: int = 1, count: int = 20, budget: int = RANGE_BUDGET) -> DataFrame:
    """Of every book, `count` pages from a page id on, cut at the character budget.

    text: text rows, as stored; only their sizes move, and repeats are dropped by them.
    """
    if not 1 <= count <= 20:
        raise ValueError("BAD_ARG: count 1 to 20")
    order = Window.partitionBy("book_id").orderBy("page_id")
    few = page.where(F.col("page_id") >= start).select("book_id", "page_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= count)
    size = F.length(F.coalesce("body", F.lit(""))) + F.length(F.coalesce("foot", F.lit("")))
    sizes = text.select("book_id", "page_id", size.alias("n_chars")).groupBy("book_id", "page_id").agg(F.max("n_chars").alias("n_chars"))
    rows = few.join(sizes, ["book_id", "page_id"], "left").withColumn("n_chars", F.coalesce("n_chars", F.lit(0)))
    return rows.withColumn("keep", budget_inclusive(F.col("n_chars"), order, budget)).where("keep").select("book_id", "page_id", "n_chars")


def page_sizes(page: DataFrame, text: DataFrame) -> DataFrame:
    """Every page with label, neighbours and the lengths of its displayed text and foot: of page_view() what needs no text to move."""
    body = F.length(plain_text(F.coalesce("body", F.lit(""))))
    sizes = text.select("book_id", "page_id", body.alias("n"), F.length(F.coalesce("foot", F.lit(""))).alias("f")).groupBy("book_id", "page_id").agg(F.max("n").alias("n_chars"), F.max("f").alias("n_foot"))
    rows = neighbours(page).join(sizes, ["book_id", "page_id"], "left")
    return rows.select("book_id", "page_id", clean_part(F.col("part")).alias("part"), printed_label(F.col("part"), F.col("page")).alias("printed_page"), "prev_page_id", "next_page_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.coalesce("n_foot", F.lit(0)).alias("n_foot"))


def annotations(page: DataFrame) -> DataFrame:
    """Parsed page annotations: valid, ayat, hadeeth, esnad; broken JSON keeps its raw text and has no lists."""
    v = F.try_parse_json("services")
    get = lambda name, kind: F.coalesce(F.try_variant_get(v, f"$.{name}", f"array<{kind}>"), F.array().cast(f"array<{kind}>"))
    return page.where("services is not null").select("book_id", "page_id", F.col("services").alias("raw"), v.isNotNull().alias("valid"), get("ayat", "int").alias("ayat"), get("hadeeth", "int").alias("hadeeth"), get("esnad", "string").alias("esnad"))
