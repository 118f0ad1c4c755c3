"""Key services: which pages of which books treat a verse or a tradition, and how complete that is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.verses import aya_dim
from quire.operators.catalog import with_main_author
from quire.operators.pages import annotations, budget_exclusive

#: The categories whose downloaded books are expected to treat a verse (a parameter).
SHELF = (3, 4)
STATUS = ("indexed_covers", "indexed_no_entry_for_this_aya", "not_indexed_coverage_unknown")


def entries(service: DataFrame, name: str, book: DataFrame, author: DataFrame, downloaded_only: bool = False) -> DataFrame:
    """All entries of a service with the book's name, author and availability; unknown books are named so."""
    b = with_main_author(book, author).select("book_id", "book_name", "author_name", "downloaded")
    rows = service.where(F.col("service_name") == name).join(b, "book_id", "left")
    rows = rows.select("key_id", "book_id", "page_id", F.coalesce("book_name", F.concat(F.lit("(unknown "), F.col("book_id").cast("string"), F.lit(")"))).alias("book_name"), "author_name", F.coalesce("downloaded", F.lit(False)).alias("downloaded"))
    return rows.where("downloaded") if downloaded_only else rows


def verse_entries(service: DataFrame, book: DataFrame, author: DataFrame) -> DataFrame:
    """Entries of verses with sura and verse; the verse table has a fixed 6,236 rows and is broadcast."""
    return entries(service, "tafseer", book, author).join(F.broadcast(aya_dim(service.sparkSession)).withColumnRenamed("aya_id", "key_id"), "key_id")


def verse_coverage(service: DataFrame, book: DataFrame, author: DataFrame, aya_id: int, shelf: tuple[int, ...] = SHELF, in_service: DataFrame | None = None) -> DataFrame:
    """Books that treat a verse, take part without an entry, or are not indexed: shelf books united with hits."""
    tafseer = service.where("service_name = 'tafseer'")
    hits = tafseer.where(F.col("key_id") == aya_id).groupBy("book_id").agg(F.min("page_id").alias("page_id"))
    own = book.where(F.col("downloaded") & F.col("book_category").isin(*shelf)).select("book_id")
    taking = (in_service if in_service is not None else tafseer.select("book_id")).distinct().withColumn("taking", F.lit(True))
    rows = own.unionByName(hits.select("book_id")).distinct().join(hits, "book_id", "left").join(taking, "book_id", "left")
    rows = rows.join(with_main_author(book, author).select("book_id", "book_name", "author_name", "death_year", "book_category", "downloaded"), "book_id", "left")
    status = F.when(F.col("page_id").isNotNull(), STATUS[0]).when(F.col("taking"), STATUS[1]).otherwise(STATUS[2])
    order = F.when(F.col("status") == STATUS[0], 0).when(F.col("status") == STATUS[1], 1).otherwise(2)
    return (
        rows.withColumn("status", status)
        .select("book_id", F.coalesce("book_name", F.concat(F.lit("(unknown "), F.col("book_id").cast("string"), F.lit(")"))).alias("book_name"), "author_name", "death_year", F.col("book_category").alias("category_id"), F.coalesce(F.col("book_category").isin(*shelf), F.lit(False)).alias("on_shelf"), F.coalesce("downloaded", F.lit(False)).alias("downloaded"), "status", "page_id")
        .orderBy(order, F.desc("downloaded"), "book_id")
    )


def coverage_totals(service: DataFrame, book: DataFrame, shelf: tuple[int, ...] = SHELF) -> DataFrame:
    """For every verse with an entry, the numbers of books of the three kinds, without listing them."""
    tafseer = service.where("service_name = 'tafseer'").select("key_id", "book_id").distinct()
    own = book.where(F.col("downloaded") & F.col("book_category").isin(*shelf)).select("book_id")
    taking = tafseer.select("book_id").distinct().withColumn("taking", F.lit(1))
    size = own.join(taking, "book_id", "left").agg(F.count("*").alias("own"), F.count("taking").alias("both")).first()  # two numbers
    per = tafseer.join(own.withColumn("shelved", F.lit(1)), "book_id", "left").groupBy("key_id").agg(F.count("*").alias("covers"), F.count("shelved").alias("shelved"))
    return per.select(F.col("key_id").alias("aya_id"), F.col("covers").alias("indexed_covers"), (F.lit(size["both"]) - F.col("shelved")).cast("long").alias("indexed_no_entry"), F.lit(size["own"] - size["both"]).cast("long").alias("not_indexed"))


def verse_texts(service: DataFrame, book: DataFrame, author: DataFrame, text: DataFrame, aya_id: int, max_sources: int = 10, budget: int = 12_000, book_ids: list[int] | None = None) -> DataFrame:
    """The passages of the downloaded sources of a verse, in book order, until the budget is reached.

    book_ids: only these books are ranked and budgeted, in the order they are asked for; the rest of an earlier call is asked for by them.
    """
    if not 1 <= max_sources <= 10:
        raise ValueError("BAD_ARG: max_sources 1 to 10")
    hits = service.where((F.col("service_name") == "tafseer") & (F.col("key_id") == aya_id)).groupBy("book_id").agg(F.min("page_id").alias("page_id"))
    queue = F.col("book_id")
    if book_ids:
        hits = hits.where(F.col("book_id").isin(book_ids))
        queue = F.array_position(F.array(*map(F.lit, dict.fromkeys(book_ids))), F.col("book_id").cast("int"))
    b = with_main_author(book, author).where("downloaded").select("book_id", "book_name", "author_name", "death_year")
    size = F.length(F.coalesce("body", F.lit(""))) + F.length(F.coalesce("foot", F.lit("")))
    order = Window.orderBy("queue")  # at most the sources of one verse
    rows = hits.join(b, "book_id").join(text, ["book_id", "page_id"], "left").withColumn("n_chars", size).withColumn("queue", queue).withColumn("place", F.row_number().over(order))
    kept = rows.withColumn("keep", budget_exclusive(F.col("n_chars"), order, budget) & (F.col("place") <= max_sources))
    return kept.select("place", "book_id", "book_name", "author_name", "page_id", "n_chars", F.when(F.col("keep"), "ok").otherwise("remaining").alias("status"), F.when(F.col("keep"), F.coalesce("body", F.lit(""))).alias("text"))


def source_status(service: DataFrame, book: DataFrame, aya_id: int, book_ids: list[int]) -> DataFrame:
    """For asked books: ok, no_entry_for_this_aya, not_indexed or not_downloaded."""
    spark = service.sparkSession
    asked = spark.createDataFrame([(i, b) for i, b in enumerate(dict.fromkeys(book_ids))], "place int, book_id int")
    tafseer = service.where("service_name = 'tafseer'")
    hits = tafseer.where(F.col("key_id") == aya_id).groupBy("book_id").agg(F.min("page_id").alias("page_id"))
    taking = tafseer.select("book_id").distinct().withColumn("taking", F.lit(True))
    rows = asked.join(hits, "book_id", "left").join(taking, "book_id", "left").join(book.select("book_id", "downloaded"), "book_id", "left")
    status = F.when(F.col("page_id").isNull() & F.col("taking"), "no_entry_for_this_aya").when(F.col("page_id").isNull(), "not_indexed").when(F.coalesce("downloaded", F.lit(False)), "ok").otherwise("not_downloaded")
    return rows.select("place", "book_id", "page_id", status.alias("status")).orderBy("place")


def tradition_search(hits: DataFrame, page: DataFrame, service: DataFrame, book: DataFrame, author: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of found pages (book_id, page_id) their tradition keys; and where else each distinct key stands."""
    keys = annotations(page).select("book_id", "page_id", "hadeeth")
    matches = hits.select("book_id", "page_id").distinct().join(keys, ["book_id", "page_id"], "left").withColumn("hadeeth", F.coalesce("hadeeth", F.array().cast("array<int>")))
    distinct = matches.select(F.explode("hadeeth").alias("key_id")).distinct()
    return matches, entries(service, "hadeeth", book, author).join(distinct, "key_id", "left_semi")
