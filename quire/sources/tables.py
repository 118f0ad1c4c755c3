"""Schemas of the library's tables and the views of what is valid now."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.arabic import id_list, known_year
from quire.runtime import register, shared_dir, table

BOOK = (
    "book_id INT, book_name STRING, book_category INT, book_type INT, book_date INT, authors_csv STRING, main_author INT, printed INT, group_id INT, hidden INT, "
    "major_online INT, minor_online INT, major_ondisk INT, minor_ondisk INT, pdf_links STRING, meta_data STRUCT<date: STRING, group: INT, coauthor: ARRAY<INT>, prefix: STRING, "
    "suffix: STRING, sub_books: ARRAY<INT>, shorts: MAP<STRING, STRING>, hide_diacritic: BOOLEAN, min_ver: INT>, parent INT"
)
AUTHOR = "author_id INT, author_name STRING, death_number INT, death_text STRING"
CATEGORY = "category_id INT, category_name STRING, category_order INT"
PAGE = "book_id INT, page_id INT, part STRING, page INT, number INT, services STRING"
PAGE_TEXT = "book_id INT, page_id INT, body STRING, foot STRING, comment STRING"
TITLE = "book_id INT, id INT, page INT, parent INT, body STRING"
SERVICE = "service_name STRING, key_id INT, book_id INT, page_id INT"


def latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """One valid row per key: not withdrawn, the last loaded (never loaded counts first). An aggregate, not a sort."""
    if "deleted_at" in df.columns:
        df = df.where("deleted_at is null")
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("loaded_at")).alias("r")).select(*keys, *[F.col(f"r.`{c}`").alias(c) for c in rest])


def books(df: DataFrame) -> DataFrame:
    """The catalogue view of book rows: unknown years and authors null, no null names."""
    return latest(df, ["book_id"]).select(
        "book_id", F.coalesce("book_name", F.lit("")).alias("book_name"), "book_category", F.coalesce("book_type", F.lit(1)).alias("book_type"), known_year(F.col("book_date")).alias("book_date"),
        "authors_csv", F.when(F.col("main_author") > 0, F.col("main_author")).alias("main_author"), F.coalesce("printed", F.lit(0)).alias("printed"), F.coalesce("major_online", F.lit(0)).alias("major_online"),
        F.coalesce("major_ondisk", F.lit(0)).alias("major_ondisk"), "pdf_links", "meta_data", (F.coalesce("major_ondisk", F.lit(0)) > 0).alias("downloaded"),
    )


def authors(df: DataFrame) -> DataFrame:
    return latest(df, ["author_id"]).select("author_id", "author_name", known_year(F.col("death_number")).alias("death_year"), "death_text")


def author_bridge(book: DataFrame) -> DataFrame:
    """Every (author_id, book_id): main, packed and co-authors."""
    ids = F.concat(F.array("main_author"), id_list(F.col("authors_csv")), F.coalesce(F.col("meta_data.coauthor"), F.array().cast("array<int>")))
    return book.select(F.explode(F.filter(F.array_distinct(ids), lambda x: x > 0)).alias("author_id"), "book_id")


def titles(df: DataFrame) -> DataFrame:
    return latest(df, ["book_id", "id"])


def pages(df: DataFrame) -> DataFrame:
    return latest(df, ["book_id", "page_id"])


def page_texts(df: DataFrame) -> DataFrame:
    """Repeats of a page's text are identical, so any one stands for all."""
    return df.groupBy("book_id", "page_id").agg(F.first(F.struct("body", "foot", "comment")).alias("t")).select("book_id", "page_id", "t.body", "t.foot", "t.comment")


#: Indexes saved so far, by folder, table and the state of its files.
_indexes: dict[tuple, object] = {}


@dataclass
class Library:
    """The views of a data folder."""

    spark: SparkSession
    folder: str

    def _raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @property
    def book(self) -> DataFrame:
        return books(self._raw("book"))

    @property
    def author(self) -> DataFrame:
        return authors(self._raw("author"))

    @property
    def page(self) -> DataFrame:
        return pages(self._raw("page"))

    @property
    def page_text(self) -> DataFrame:
        return page_texts(self._raw("page_text"))

    @property
    def page_text_rows(self) -> DataFrame:
        """The text rows as stored, repeats included: searching a large table of them moves no text."""
        return table(self.spark, self.folder, "page_text", ("book_id", "page_id"))

    @property
    def title(self) -> DataFrame:
        return titles(self._raw("title"))

    @property
    def service(self) -> DataFrame:
        """Distinct key entries of the three services."""
        return self._raw("service").select("service_name", "key_id", "book_id", "page_id").distinct()

    def index(self, name: str):  # noqa: ANN201
        """The search index of page_text or title, saved in the shared folder at its first use and again after its table's files changed.

        For libraries that stay, build an Index at a path of your own and open it.
        """
        from quire.operators.postings import WORDS, Index

        spark = self.spark
        context = spark.sparkContext
        p = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.parquet")
        store = p.getFileSystem(context._jsc.hadoopConfiguration())
        state = store.getFileStatus(p)
        files = store.listStatus(p) if state.isDirectory() else [state]
        key = (context.applicationId, self.folder, name, max((f.getModificationTime() for f in files), default=0), sum(f.getLen() for f in files))
        if key not in _indexes:
            path = f"{shared_dir(spark)}/quire-index-{name}-{abs(hash(key)):x}"
            register(spark, path)
            # repeats of a text are harmless to the index, so no text is shuffled; of titles only the last counts
            rows, keys, fields, kinds = (self.page_text_rows, ["book_id", "page_id"], ["body", "foot", "comment"], None) if name == "page_text" else (self.title, ["book_id", "id"], ["body"], (WORDS,))
            _indexes[key] = Index.build(rows, keys, fields, path, *([kinds] if kinds else []))
        return _indexes[key]
