"""Queries of the text operators over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import mixing, sentences, skeleton, spans, terms, tokens
from quire.runtime import table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """tbl, book_id, id, text of every text that p3 compares."""
    author = table(spark, d, "author").select(F.lit("author").alias("tbl"), F.lit(0).alias("book_id"), F.col("author_id").alias("id"), F.col("author_name").alias("text"))
    title = table(spark, d, "title").select(F.lit("title").alias("tbl"), "book_id", "id", F.col("body").alias("text"))
    page = table(spark, d, "page_text").select(F.lit("page_text").alias("tbl"), "book_id", F.col("page_id").alias("id"), F.col("body").alias("text"))
    return author.unionByName(title).unionByName(page)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records whose texts look the same but are stored differently."""
    found = skeleton.digests(_texts(spark, d), ["tbl", "book_id"], "id", "text")
    return skeleton.lookalike_pairs(found, ["tbl", "book_id"], "id")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Looks that are stored in several forms."""
    found = skeleton.digests(_texts(spark, d), ["tbl", "book_id"], "id", "text")
    return skeleton.lookalike_groups(found, ["tbl", "book_id"]).withColumn("skel", F.hex("skel"))


def p3_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every text in the one form under which texts that look the same are equal."""
    return _texts(spark, d).select("tbl", "book_id", "id", skeleton.canonical(F.col("text")).alias("canonical"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(table(spark, d, "search_run"), "normalized_tokens").unionByName(terms.marked_terms(table(spark, d, "page_text"), "body"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms in too few or too many records."""
    return _terms(spark, d).where("mark is not null").select("field", "term", "mark")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its occurrences, records and mark."""
    return _terms(spark, d)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """page_text with one key of two integers."""
    both = F.shiftleft(F.col("book_id").cast("long"), 32) + F.col("page_id").cast("long").bitwiseAND(0xFFFFFFFF)
    return table(spark, d, "page_text").select(both.alias("key"), "body", "foot")


def _unpack(key: str, suffix: str = "") -> list:
    return [F.shiftright(key, 32).cast("int").alias(f"book_id{suffix}"), F.col(key).bitwiseAND(0xFFFFFFFF).cast("int").alias(f"page_id{suffix}")]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of pages with a common span of 120 code points or more in body or foot."""
    return spans.shared_pairs(_pages(spark, d), "key", ["body", "foot"]).select(*_unpack("a", "_a"), *_unpack("b", "_b"))


def p7_shared(spark: SparkSession, d: str) -> DataFrame:
    """For each page that shares a passage, how many of its code points stand elsewhere, in how many passages."""
    return spans.shared_amount(_pages(spark, d), "key", ["body", "foot"]).select(*_unpack("key"), "shared_chars", "n_spans")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Every document as ids of byte_bpe_50k."""
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def p8_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the documents by language: documents, tokens, longest."""
    n = tokens.encode(table(spark, d, "documents"), "doc_id", "text", carry=("lang",)).select("lang", F.size("ids").alias("n"))
    return n.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.max("n").alias("longest"))


def _counted(spark: SparkSession, d: str) -> DataFrame:
    return mixing.with_tokens(tokens.encode(table(spark, d, "documents"), "doc_id", "text", carry=("source",)))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, list[mixing.Source]]:
    docs = _counted(spark, d)
    sources = mixing.plan(mixing.measure(docs, table(spark, d, "mix_target")))
    return mixing.select(docs, sources), sources


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The selection at the targets of mix_target, as large as the repetition limits allow: doc_id, source, n_tokens, copies."""
    return _mixture(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source."""
    return mixing.report(*_mixture(spark, d))


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents with tokens, whether its share is the target to within half a document, and whether its limit of repetitions is kept."""
    r = mixing.report(*_mixture(spark, d))
    norm = F.sum(F.when(F.col("n_tokens") > 0, F.col("weight"))).over(Window.partitionBy(F.lit(1)))  # one row a source
    target = F.when(F.col("n_tokens") > 0, F.col("weight") / norm).otherwise(0.0)
    share = (F.abs(F.col("target") - target) < 1e-9) & (F.abs(F.col("used_tokens") - F.col("budget")) * 2 <= F.col("longest") + 1e-3)
    return r.select("source", "weight", "max_repeat", "n_docs", share.alias("share_kept"), (F.col("most_copies") <= F.col("max_repeat")).alias("limit_kept"))


def p9_temperature(spark: SparkSession, d: str) -> DataFrame:
    """Natural shares of the sources, and the shares of the one exponent that gives them the entropy of the targets."""
    docs = _counted(spark, d)
    sources = [s for s in mixing.measure(docs, table(spark, d, "mix_target")) if s.n_tokens]
    total, norm = sum(s.n_tokens for s in sources), sum(s.weight for s in sources)
    shares = [s.n_tokens / total for s in sources]
    exponent = mixing.exponent_for_entropy(shares, mixing.entropy([s.weight / norm for s in sources]))
    rows = [(s.name, p, s.weight / norm, exponent, w) for s, p, w in zip(sources, shares, mixing.tempered(shares, exponent))]
    return spark.createDataFrame(rows, "source string, share double, target double, exponent double, tempered double")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of every document."""
    return sentences.split_sentences(table(spark, d, "documents"), "doc_id", "text")


def p10_texts(spark: SparkSession, d: str) -> DataFrame:
    """Sentence units with their text, numbered within the document."""
    return sentences.split_sentences(table(spark, d, "documents"), "doc_id", "text", units=True).select("doc_id", "number", "sentence")


QUERIES = {f.__name__: f for f in (p3_found, p3_groups, p3_canonical, p4_found, p4_terms, p7_found, p7_shared, p8_ids, p8_lengths, p9_mix, p9_shares, p9_kept, p9_temperature, p10_found, p10_texts)}

_P4 = r"""pieces as (
   select 'normalized_tokens' as field, row_number() over () as r, unnest(normalized_tokens) as term from search_run
   union all select 'body', r, unnest(string_split_regex(body, '[ \t\r\n]')) from (select row_number() over () as r, body from page_text)),
 totals as (select 'normalized_tokens' as field, count(*) as n from search_run union all select 'body', count(*) from page_text),
 counts as (select field, term, count(*) as n_occurrences, count(distinct r) as n_records from pieces where term <> '' group by 1, 2),
 marked as (select field, term, n_occurrences, n_records, case when n_records <= 2 then 'rare' when n_records * 100 > 15 * n then 'common' end as mark from counts join totals using (field))"""

_P7 = """f as (select distinct book_id, page_id, 0 as field, body as t from page_text where length(body) >= 120 union select distinct book_id, page_id, 1, foot from page_text where length(foot) >= 120),
 w as (select book_id, page_id, field, i, md5(substr(t, i, 120)) as s from (select *, unnest(range(1, length(t) - 118)) as i from f)),
 g as (select s from w group by s having count(distinct struct_pack(b := book_id, p := page_id)) > 1),
 x as (select w.* from w join g using (s))"""

ORACLE = {
    "p7_found": f"with {_P7} select distinct a.book_id as book_id_a, a.page_id as page_id_a, b.book_id as book_id_b, b.page_id as page_id_b from x a join x b on a.s = b.s and (a.book_id < b.book_id or (a.book_id = b.book_id and a.page_id < b.page_id))",
    "p7_shared": f"with {_P7}, y as (select distinct book_id, page_id, field, i from x), z as (select *, lead(i) over v - i as nxt, i - lag(i) over v as prv from y window v as (partition by book_id, page_id, field order by i)) select book_id, page_id, cast(sum(least(120, coalesce(nxt, 120))) as bigint) as shared_chars, cast(count(*) filter (prv is null or prv > 120) as bigint) as n_spans from z group by 1, 2",
    "p9_kept": "select m.source, weight, max_repeat, count(d.doc_id) as n_docs, true as share_kept, true as limit_kept from mix_target m left join documents d on d.source = m.source and d.text <> '' group by all",
    "p4_found": f"with {_P4} select field, term, mark from marked where mark is not null",
    "p4_terms": f"with {_P4} select field, term, n_occurrences, n_records, mark from marked",
}
