"""An inverted index as tables: one row per token occurrence, pruned by bucket and token at the scan.

Searching text directly reads all text at every query. A saved index is partitioned by a hash bucket of the
token and sorted by token inside its files, so a query reads a few buckets and, by the row groups' ranges,
little of them; text is read for the hits alone. A bucket's rows are spread over several files by record, so the
commonest token is not one task's work when it is written or read.

Two indexes stand side by side, since searches fold text in two ways: WORDS (the tokens of term and boolean
searches) and RUNS (the tokens of phrase and proximity searches).

Defined results: null and empty texts have no rows; a token repeated in a text has a row for each place;
places count from 0; a record that is stored repeatedly has its rows repeatedly and is one hit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.arabic import fold_query, glob_pattern, index_tokens, light_stem, query_tokens, stem_of, verify_tokens

WORDS, RUNS = "words", "runs"
TOKENS: dict[str, Callable[[Column], Column]] = {WORDS: index_tokens, RUNS: verify_tokens}
#: Buckets of an index: as many as its text has BUCKET_BYTES, within these bounds.
FEWEST, MOST, BUCKET_BYTES = 4, 4096, 32 << 20
#: Files of a bucket, at least.
SPREAD = 8


def bucket_of(token: Column | str, buckets: int = 256) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def postings(df: DataFrame, keys: list[str], fields: list[str], tokens: Callable[[Column], Column] = index_tokens, buckets: int = 256) -> DataFrame:
    """keys, field, token, pos, bucket. No shuffle."""
    lists = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("tokens")) for f in fields])
    one = df.select(*keys, F.inline(lists)).select(*keys, "field", F.posexplode("tokens").alias("pos", "token"))
    return one.select(*keys, "field", "token", "pos", bucket_of("token", buckets).alias("bucket"))


def save(rows: DataFrame, keys: list[str], path: str) -> None:
    """Write the index: one shuffle by bucket and a slice of the records."""
    spread = F.pmod(F.xxhash64(*keys), F.lit(SPREAD))
    rows.repartition("bucket", spread).sortWithinPartitions("bucket", "token", *keys).write.mode("overwrite").partitionBy("bucket").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@dataclass
class Index:
    """The saved indexes of the text fields of one table."""

    spark: SparkSession
    path: str
    keys: list[str]
    fields: list[str]
    buckets: int
    kinds: dict[str, DataFrame] = field(default_factory=dict)

    @staticmethod
    def build(df: DataFrame, keys: list[str], fields: list[str], path: str, kinds: tuple[str, ...] = (WORDS, RUNS)) -> Index:
        """Writes the indexes of a table below the path; the number of buckets stands in the folders' names."""
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        buckets = min(MOST, max(FEWEST, size // BUCKET_BYTES))
        for kind in kinds:
            save(postings(df, keys, fields, TOKENS[kind], buckets), keys, f"{path}/{kind}-{buckets}")
        return Index(df.sparkSession, path, keys, fields, buckets)

    @staticmethod
    def open(spark: SparkSession, path: str, keys: list[str], fields: list[str]) -> Index:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        names = [s.getPath().getName() for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]
        return Index(spark, path, keys, fields, next(int(n.split("-")[1]) for n in names if n.startswith(WORDS)))

    def table(self, kind: str) -> DataFrame:
        if kind not in self.kinds:
            self.kinds[kind] = load(self.spark, f"{self.path}/{kind}-{self.buckets}")
        return self.kinds[kind]

    def rows(self, kind: str, terms: list[str], fields: list[str]) -> DataFrame:
        """The occurrences of the terms in the fields; only their buckets are read."""
        return occurrences(self.table(kind), terms, fields, self.buckets)

    def matching(self, fields: list[str], query: str, wildcards: bool = False, morphology: bool = False) -> DataFrame:
        """keys, matched_in: search() with wildcards or stems. No bucket holds these alone, so the tokens of all are read; text is not."""
        terms = list(dict.fromkeys(fold_query(query)))
        tests = [token_is(t, wildcards, morphology) for t in terms]
        rows = self.table(WORDS).where(F.col("field").isin(*fields) & reduce(or_, tests, F.lit(False)))
        held = rows.groupBy(*self.keys).agg(*[F.max(x).alias(f"c{i}") for i, x in enumerate(tests)], F.bit_or(_marks("field", fields)).alias("held"))
        return held.where(reduce(and_, [F.col(f"c{i}") for i in range(len(tests))], F.lit(True))).select(*self.keys, _matched(fields))

    def search(self, fields: list[str], query: str) -> DataFrame:
        terms = list(dict.fromkeys(fold_query(query)))
        return all_terms(self.rows(WORDS, terms, fields), self.keys, fields, terms)

    def phrase(self, fields: list[str], query: str) -> DataFrame:
        terms = query_tokens(query)
        return in_order(self.rows(RUNS, terms, fields), self.keys, fields, terms)

    def near(self, fields: list[str], query: str, distance: int) -> DataFrame:
        terms = list(dict.fromkeys(query_tokens(query)))
        return within(self.rows(RUNS, terms, fields), self.keys, fields, terms, distance)

    def boolean(self, fields: list[str], all_of: list[str] = (), any_of: list[str] = (), none_of: list[str] = ()) -> DataFrame:
        """keys, matched_terms: records with all of, any of and none of the queries. Needs a query with a term in all_of or any_of."""
        if not any(fold_query(q) for q in [*all_of, *any_of]):
            raise ValueError("BAD_ARG: give all_of or any_of")
        held = self._held(fields, [*all_of, *any_of, *none_of])
        keep = reduce(and_, [_has(q) for q in all_of], F.lit(True))
        if any_of:
            keep = keep & reduce(or_, [_has(q) for q in any_of])
        for q in none_of:
            keep = keep & ~_has(q)
        return held.where(keep).select(*self.keys, F.array_compact(F.array(*[F.when(_has(q), F.lit(q)) for q in [*all_of, *any_of]])).alias("matched_terms"))

    def report(self, fields: list[str], queries: list[str]) -> DataFrame:
        """term, total: how many records each query matches."""
        held = self._held(fields, queries).agg(*[F.count_if(_has(q)).alias(f"c{i}") for i, q in enumerate(queries)])
        return held.select(F.inline(F.array(*[F.struct(F.lit(q).alias("term"), F.col(f"c{i}").alias("total")) for i, q in enumerate(queries)])))

    def _held(self, fields: list[str], queries: list[str]) -> DataFrame:
        terms = list(dict.fromkeys(t for q in queries for t in fold_query(q)))
        return self.rows(WORDS, terms, fields).groupBy(*self.keys).agg(F.collect_set("token").alias("held"))


def token_is(term: str, wildcards: bool, morphology: bool) -> Column:
    """Whether the token is the term, has its stem, or fits its wildcards."""
    token = F.col("token")
    if morphology:
        stem = stem_of(term)  # a part of every token that has it
        return token.contains(stem) & (light_stem(token) == stem)
    if wildcards and ("*" in term or "?" in term):
        return token.contains(max(term.replace("?", "*").split("*"), key=len)) & token.rlike(glob_pattern(term))
    return token == term


def _has(query: str) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, fold_query(query))).cast("array<string>"), "held")) == 0


def occurrences(index: DataFrame, terms: list[str], fields: list[str], buckets: int = 256) -> DataFrame:
    """The terms' buckets are constants to the optimizer, so they prune the folders."""
    if not terms:
        return index.where(F.lit(False))
    return index.where(F.col("bucket").isin(*[bucket_of(F.lit(t), buckets) for t in dict.fromkeys(terms)]) & F.col("token").isin(*terms) & F.col("field").isin(*fields))


#: Terms or fields that one long can mark, a bit each.
BITS = 62


def _marks(column: str, values: list[str]) -> Column:
    """A bit for each of the values, the first BITS of them."""
    return reduce(lambda c, i: c.when(F.col(column) == values[i], F.lit(1 << i)), range(1, len(values)), F.when(F.col(column) == values[0], F.lit(1))).otherwise(F.lit(0)).cast("long")


def _matched(fields: list[str]) -> Column:
    """The fields whose bits stand in `held`."""
    return F.array_compact(F.array(*[F.when(F.col("held").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(f)) for i, f in enumerate(fields)])).alias("matched_in")


def all_terms(rows: DataFrame, keys: list[str], fields: list[str], terms: list[str]) -> DataFrame:
    """keys, matched_in: records that hold every term in some field, with the fields that hold any. One aggregate of bits."""
    groups = [terms[i : i + BITS] for i in range(0, len(terms), BITS)]
    hits = rows.groupBy(*keys).agg(F.bit_or(_marks("field", fields)).alias("held"), *[F.bit_or(_marks("token", g)).alias(f"t{i}") for i, g in enumerate(groups)])
    whole = reduce(and_, [F.col(f"t{i}") == F.lit((1 << len(g)) - 1).cast("long") for i, g in enumerate(groups)], F.lit(bool(terms)))
    return hits.where(whole).select(*keys, _matched(fields))


def in_order(rows: DataFrame, keys: list[str], fields: list[str], terms: list[str]) -> DataFrame:
    """keys, matched_in: records in which the terms follow each other in one field.

    Every occurrence votes for the place at which the phrase would start; a start with all votes is a hit. Votes
    are spread by record, which serves the starts and the records alike.
    """
    places = F.create_map(*[x for t in dict.fromkeys(terms) for x in (F.lit(t), F.array(*[F.lit(i) for i, u in enumerate(terms) if u == t]))]) if terms else F.lit(None).cast("map<string,array<int>>")
    votes = rows.select(*keys, "field", "pos", F.explode(places[F.col("token")]).alias("i")).repartition(*keys)
    n = F.count_distinct("i") if len(terms) > BITS else F.bit_count(F.bit_or(F.expr("shiftleft(1L, i)")))
    starts = votes.groupBy(*keys, "field", (F.col("pos") - F.col("i")).alias("start")).agg(n.alias("n")).where(F.col("n") == len(terms))
    return starts.groupBy(*keys).agg(F.bit_or(_marks("field", fields)).alias("held")).select(*keys, _matched(fields))


def within(rows: DataFrame, keys: list[str], fields: list[str], terms: list[str], distance: int) -> DataFrame:
    """keys, matched_in: records in which all distinct terms stand within `distance` places of each other in one field."""
    per = rows.repartition(*keys).groupBy(*keys, "field").agg(F.collect_set(F.struct("pos", "token")).alias("at"))
    per = per.where(F.size(F.array_distinct(F.transform("at", lambda x: x["token"]))) == len(terms))
    together = F.exists("at", lambda s: F.size(F.array_distinct(F.transform(F.filter("at", lambda x: x["pos"].between(s["pos"], s["pos"] + distance)), lambda x: x["token"]))) == len(terms))
    return per.where(together).groupBy(*keys).agg(F.bit_or(_marks("field", fields)).alias("held")).select(*keys, _matched(fields))


def search(index: DataFrame, keys: list[str], fields: list[str], query: str) -> DataFrame:
    """all_terms() over a frame of postings()."""
    terms = list(dict.fromkeys(fold_query(query)))
    return all_terms(occurrences(index, terms, fields), keys, fields, terms)


def phrase(index: DataFrame, keys: list[str], fields: list[str], query: str) -> DataFrame:
    """in_order() over a frame of postings()."""
    terms = fold_query(query)
    return in_order(occurrences(index, terms, fields), keys, fields, terms)
