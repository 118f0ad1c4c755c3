"""Scope algebra: which books a query ranges over, with the size of every source.

Sources are intersected; inside one source values are united. Absent and empty sources do not constrain.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.tables import author_bridge


@dataclass(frozen=True)
class Scope:
    book_ids: tuple[int, ...] = field(default=())
    author_ids: tuple[int, ...] = field(default=())
    category_ids: tuple[int, ...] = field(default=())
    period_from: int | None = None
    period_to: int | None = None
    downloaded_only: bool = False

    def __post_init__(self) -> None:
        for name in ("book_ids", "author_ids", "category_ids"):
            if any(not isinstance(x, int) or x <= 0 for x in getattr(self, name)):
                raise ValueError(f"BAD_ARG: {name} holds positive integers")
        for year in (self.period_from, self.period_to):
            if year is not None and not 1 <= year <= 2000:
                raise ValueError("BAD_ARG: years are 1 to 2000")


def sources(scope: Scope, book: DataFrame, author: DataFrame) -> dict[str, DataFrame]:
    """The book ids that each given source contributes."""
    out = {}
    if scope.book_ids:
        ids = F.explode(F.array(*map(F.lit, sorted(set(scope.book_ids)))))
        out["book_ids"] = book.sparkSession.range(1).select(ids.alias("book_id"))
    if scope.author_ids:
        out["author_ids"] = author_bridge(book).where(F.col("author_id").isin(*scope.author_ids)).select("book_id").distinct()
    if scope.category_ids:
        out["category_ids"] = book.where(F.col("book_category").isin(*scope.category_ids)).select("book_id")
    if scope.period_from is not None or scope.period_to is not None:
        a, b = scope.period_from or 1, scope.period_to or 9999
        written = book.where(F.col("book_date").between(a, b)).select("book_id")
        people = author.where(F.col("death_year").between(a, b)).select("author_id")
        out[f"period[{a}..{b}]"] = written.unionByName(author_bridge(book).join(people, "author_id", "left_semi").select("book_id")).distinct()
    if scope.downloaded_only:
        out["downloaded_only"] = book.where("downloaded").select("book_id")
    return out


def resolve(scope: Scope | None, book: DataFrame, author: DataFrame) -> DataFrame:
    """The book ids of the scope: an intersection by semi-joins; all books without a source."""
    given = list(sources(scope, book, author).values()) if scope else []
    return reduce(lambda x, y: x.join(y, "book_id", "left_semi"), given) if given else book.select("book_id")


def diagnostics(scope: Scope, book: DataFrame, author: DataFrame) -> DataFrame:
    """source, contributed: the size of each source and of the intersection."""
    given = sources(scope, book, author)
    rows = [df.agg(F.count("*").alias("contributed")).select(F.lit(n).alias("source"), "contributed") for n, df in given.items()]
    if given:
        rows.append(resolve(scope, book, author).agg(F.count("*").alias("contributed")).select(F.lit("intersection").alias("source"), "contributed"))
    return reduce(DataFrame.unionByName, rows) if rows else book.sparkSession.createDataFrame([], "source string, contributed long")


def within(df: DataFrame, scope: Scope | None, book: DataFrame, author: DataFrame) -> DataFrame:
    """Rows whose book lies in the scope; no join without one. Catalyst broadcasts the ids if they are small enough."""
    return df if scope is None or not sources(scope, book, author) else df.join(resolve(scope, book, author), "book_id", "left_semi")
