"""Text search over whole relations: terms, wildcards, stems, phrases, proximity, exactness, set algebra.

Whole tokens, phrases and exact strings are found by one regular expression, made from the folds, on the text
as it is stored; token arrays are built only where distance, wildcards or stems need every token.
Nothing is capped and every order is explicit. Results are DataFrames; paginate() gives the window of a page
of results, coverage() the roll-ups of all. Repeated rows of a record match alike, so callers remove them from
the hits, not from the texts.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.arabic import century, exact_pattern, fold_exact, fold_query, fold_token, glob_pattern, index_part_pattern, index_pattern, index_tokens, light_stem, query_tokens, stem_of, strip_tags, verify_pattern, verify_tokens


def check_options(morphology: bool = False, wildcards: bool = False, preserve: bool = False) -> None:
    if preserve:
        raise ValueError("OPTION_NOT_SUPPORTED: exactness belongs to exact search")
    if morphology and wildcards:
        raise ValueError("OPTION_CONFLICT: morphology and wildcards exclude each other")


def _literal(term: str) -> str:
    """The longest part of a term without wildcards."""
    return max(term.replace("?", "*").split("*"), key=len)


def term_in(field: str, term: str, wildcards: bool = False, morphology: bool = False) -> Column:
    """Whether the field holds the (folded) term as a token."""
    text = F.coalesce(F.col(field), F.lit(""))
    if morphology:
        stem = stem_of(term)  # a part of every token that has it
        return text.rlike(index_part_pattern(stem)) & F.exists(F.filter(index_tokens(F.col(field)), lambda t: t.contains(stem)), lambda t: light_stem(t) == stem)
    if wildcards and ("*" in term or "?" in term):
        near = text.rlike(index_part_pattern(_literal(term))) if _literal(term) else F.lit(True)
        return near & F.exists(index_tokens(F.col(field)), lambda t: t.rlike(glob_pattern(term)))
    if not term.isalnum():
        return F.lit(False)  # no token holds anything but letters and digits
    return strip_tags(text).rlike(index_pattern(term))


def any_field(fields: list[str], term: str, **options: bool) -> Column:
    return reduce(or_, [term_in(f, term, **options) for f in fields])


def search(df: DataFrame, fields: list[str], query: str, wildcards: bool = False, morphology: bool = False) -> DataFrame:
    """Rows in which every term stands in one of the fields; matched_in lists the fields with any term."""
    check_options(morphology, wildcards)
    terms = fold_query(query)
    if not terms:
        return df.where(F.lit(False)).withColumn("matched_in", F.array().cast("array<string>"))
    options = {"wildcards": wildcards, "morphology": morphology}
    hits = df.where(reduce(and_, [any_field(fields, t, **options) for t in terms]))
    held = [F.when(reduce(or_, [term_in(f, t, **options) for t in terms]), F.lit(f)) for f in fields]
    return hits.withColumn("matched_in", F.array_compact(F.array(*held)))


def phrase_in(field: str, words: list[str]) -> Column:
    """Whether the words stand next to each other in the field."""
    return strip_tags(F.coalesce(F.col(field), F.lit(""))).rlike(verify_pattern(words))


def near_in(field: str, words: list[str], distance: int) -> Column:
    """Whether all distinct words stand within `distance` places of each other."""
    want = F.array(*map(F.lit, dict.fromkeys(words)))
    return _with(verify_tokens(F.col(field)), lambda h: F.exists(_starts(h, 1), lambda i: F.size(F.array_except(want, F.slice(h, i, distance + 1))) == 0))


def _with(value: Column, then) -> Column:  # noqa: ANN001
    """Binds an expression once for use in several places."""
    return F.transform(F.array(value), then)[0]


def _starts(h: Column, n: int) -> Column:
    return F.when(F.size(h) >= n, F.sequence(F.lit(1), F.size(h) - (n - 1))).otherwise(F.array().cast("array<int>"))


def check_mode(mode: str, distance: int) -> None:
    if mode not in ("phrase", "near") or not 1 <= distance <= 50:
        raise ValueError("BAD_ARG: mode is phrase or near, distance 1 to 50")


def search_phrase(df: DataFrame, fields: list[str], query: str, mode: str = "phrase", distance: int = 10) -> DataFrame:
    """Rows with the phrase, or with all words near each other, within one field."""
    words = query_tokens(query)
    check_mode(mode, distance)
    if not words:
        return df.where(F.lit(False)).withColumn("matched_in", F.array().cast("array<string>"))
    if mode == "phrase":
        found = [phrase_in(f, words) for f in fields]
        return df.where(reduce(or_, found)).withColumn("matched_in", F.array_compact(F.array(*[F.when(x, F.lit(f)) for f, x in zip(fields, found)])))
    # the cheap test first: every word somewhere in one field
    rough = reduce(or_, [reduce(and_, [phrase_in(f, [w]) for w in dict.fromkeys(words)]) for f in fields])
    held = [F.when(near_in(f, words, distance), F.lit(f)) for f in fields]
    return df.where(rough).withColumn("matched_in", F.array_compact(F.array(*held))).where(F.size("matched_in") > 0)


def search_exact(df: DataFrame, fields: list[str], query: str, diacritics: bool = False, hamza: bool = False, digits: bool = False) -> DataFrame:
    """Rows in which a field holds the query as a substring at the chosen exactness."""
    flags = {"diacritics": diacritics, "hamza": hamza, "digits": digits}
    needle = fold_exact(query, **flags)
    if not needle:
        return df.where(F.lit(False)).withColumn("matched_in", F.array().cast("array<string>"))
    found = [strip_tags(F.coalesce(F.col(f), F.lit(""))).rlike(exact_pattern(needle, **flags)) for f in fields]
    return df.where(reduce(or_, found)).withColumn("matched_in", F.array_compact(F.array(*[F.when(x, F.lit(f)) for f, x in zip(fields, found)])))


def _all_terms(fields: list[str], text: str) -> Column:
    return reduce(and_, [any_field(fields, t) for t in fold_query(text)], F.lit(True))


def search_boolean(df: DataFrame, fields: list[str], all_of: list[str] = (), any_of: list[str] = (), none_of: list[str] = ()) -> DataFrame:
    """Rows with all of, any of and none of the given queries, in one predicate; matched_terms lists those that hold."""
    if not all_of and not any_of:
        raise ValueError("BAD_ARG: give all_of or any_of")
    keep = reduce(and_, [_all_terms(fields, t) for t in all_of], F.lit(True))
    if any_of:
        keep = keep & reduce(or_, [_all_terms(fields, t) for t in any_of])
    for t in none_of:
        keep = keep & ~_all_terms(fields, t)
    matched = F.array_compact(F.array(*[F.when(_all_terms(fields, t), F.lit(t)) for t in [*all_of, *any_of]]))
    return df.where(keep).withColumn("matched_terms", matched)


def term_report(df: DataFrame, fields: list[str], terms: list[str], keys: list[str]) -> DataFrame:
    """term, total: how many records each query matches, all in one pass; repeated rows of a record count once."""
    found = df.groupBy(*keys).agg(*[F.max(_all_terms(fields, t)).alias(f"c{i}") for i, t in enumerate(terms)])
    counts = found.agg(*[F.count_if(f"c{i}").alias(f"c{i}") for i in range(len(terms))])
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"c{i}").alias("total")) for i, t in enumerate(terms)])
    return counts.select(F.inline(pairs))


def paginate(df: DataFrame, order: list, limit: int = 20, offset: int = 0) -> DataFrame:
    """The window of an ordered result; top-k with an offset, not a full sort."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("BAD_ARG: limit 1 to 100, offset 0 or more")
    return df.orderBy(*order).offset(offset).limit(limit)


def envelope(total: int, returned: int, offset: int) -> dict:
    """What tells a reader whether more results follow."""
    more = offset + returned < total
    return {"total_hits": total, "returned": returned, "offset": offset, "has_more": more} | ({"next_offset": offset + returned} if more else {})


def enrich(hits: DataFrame, book: DataFrame, author: DataFrame, page: DataFrame | None = None) -> DataFrame:
    """Hits with the book's name, author, category and year, and the printed page label."""
    from quire.functions.arabic import printed_label
    from quire.operators.catalog import with_main_author

    b = with_main_author(book, author).select("book_id", "book_name", "author_name", F.col("book_category").alias("category_id"), "book_date")
    out = hits.join(b, "book_id", "left").withColumn("book_name", F.coalesce("book_name", F.concat(F.lit("(unknown "), F.col("book_id").cast("string"), F.lit(")"))))
    if page is not None:
        out = out.join(page.select("book_id", "page_id", printed_label(F.col("part"), F.col("page")).alias("printed_page")), ["book_id", "page_id"], "left")
    return out


def hits_per_book(hits: DataFrame, record: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """book_id, n_hits: distinct records (book_id and the record columns) per book."""
    return hits.select("book_id", *record).distinct().groupBy("book_id").agg(F.count("*").alias("n_hits"))


def coverage(per_book: DataFrame, book: DataFrame, author: DataFrame, top: int = 10) -> DataFrame:
    """kind, id, n_hits: all hits by category, century (null: undated) and the top books and authors.

    per_book: book_id, n_hits. One aggregate with grouping sets over the per-book counts.
    """
    from quire.operators.catalog import with_main_author

    b = with_main_author(book, author).select("book_id", F.col("book_category").alias("category"), century(F.col("book_date")).alias("century"), F.when(F.col("author_name").isNotNull(), F.col("main_author")).alias("author"))
    joined = per_book.join(b, "book_id").select(F.col("book_id").alias("book"), "n_hits", "category", "century", "author")
    sets = joined.groupingSets([[F.col("category")], [F.col("century")], [F.col("book")], [F.col("author")]], "category", "century", "book", "author").agg(F.sum("n_hits").alias("n_hits"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 7, "category").when(F.col("g") == 11, "century").when(F.col("g") == 13, "book").otherwise("author")
    rows = sets.select(kind.alias("kind"), F.coalesce("category", "century", "book", "author").alias("id"), "n_hits").where("id is not null or kind = 'century'")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n_hits"), "id"))
    ranked = rows.where("kind in ('book', 'author')").withColumn("place", place).where(F.col("place") <= top).drop("place")
    return rows.where("kind in ('category', 'century')").unionByName(ranked)


def root_stats(df: DataFrame, fields: list[str], root: str, book: DataFrame, author: DataFrame, top: int = 15) -> DataFrame:
    """The distribution of the rows whose tokens share the root's (approximate) stem."""
    return coverage(hits_per_book(search(df, fields, root, morphology=True)), book, author, top)


def _starting(word: str):  # noqa: ANN202
    return lambda t: t.startswith(word)


def autocomplete(df: DataFrame, key: str, name: str, query: str, kind: str, limit: int = 10) -> DataFrame:
    """Names in which every term starts a token, scored by the share of the name's letters the terms cover."""
    if not 1 <= limit <= 20:
        raise ValueError("BAD_ARG: limit 1 to 20")
    terms = fold_query(query)
    tokens = index_tokens(F.col(name))
    starts = [F.exists(tokens, _starting(w)) for w in terms]
    whole = reduce(lambda a, b: a + b, [F.array_contains(tokens, w).cast("int") for w in terms], F.lit(0))
    size = F.length(F.array_join(tokens, ""))
    score = F.round(F.lit(float(sum(map(len, terms)))) / size + whole, 6)
    hits = df.where(reduce(and_, starts, F.lit(bool(terms)))).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(name).alias("name"), score.alias("score"))
    return hits.orderBy(F.desc("score"), "id").limit(limit)


def verse_search(df: DataFrame, field: str, key: str, query: str, wildcards: bool = False) -> DataFrame:
    """Short-text search in key order; a single plain word also matches with particles and the article on it."""
    from quire.functions.arabic import prefix_variants

    terms = fold_query(query)
    if len(terms) == 1 and not (wildcards and ("*" in terms[0] or "?" in terms[0])):
        forms = F.array(*map(F.lit, dict.fromkeys(fold_token(f) for f in prefix_variants(terms[0]))))
        hits = df.where(F.arrays_overlap(index_tokens(F.col(field)), forms))
    else:
        hits = search(df, [field], query, wildcards=wildcards).drop("matched_in")
    return hits.orderBy(key)
