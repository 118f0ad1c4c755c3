"""Mixing sources to target weights, in tokens, with a cap on the repetitions of each source.

Temperature mixing: the token shares of the sources are raised to an exponent and normalised, and the exponent
is bisected until the mixture has the entropy of the target weights. One exponent cannot give every source its
own weight, so each tempered share is then corrected by (target / tempered) to a strength, bisected too: the
greatest in [0, 1] at which no source is repeated more often than it may be at the asked total. At strength 1
the weights are the targets, which is always so at the default total, the largest that allows it. Where even
the tempered shares ask too much of a source, the exponent is bisected on, towards 1 (the natural shares), to
the repetition limit. The weights are then realised as budgeted block permutations: a hash permutes the documents of a
source, whole passes are copies of all of them, and the part of a pass is a prefix of the permutation whose
last document is found block by block, so that no source, even one that holds a third of all rows, is ever
sorted in one task.

Defined results: sources that are null, without a target, or whose documents have no tokens are not used; a
target source without documents is reported with 0 and its weight is spread over the others in proportion;
documents without tokens are never selected; equal texts under several ids are several documents; repeated
rows of a document are taken or left together; repeated target rows of one source are an error; with no usable
source the selection is empty.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.runtime import materialize

#: The most target sources; targets and their totals are parameters, held by the driver.
MAX_SOURCES = 10_000
#: Hash bits of a block level: 2 levels of 4096 blocks, then documents.
BITS = 12


@dataclass
class Source:
    name: str
    weight: float
    max_repeat: int
    n_docs: int = 0
    n_tokens: int = 0
    longest: int = 0
    tempered: float = 0.0
    target: float = 0.0
    budget: float = 0.0


def tempered(shares: list[float], exponent: float) -> list[float]:
    """Shares raised to the exponent and normalised; zero shares stay zero."""
    raised = [s**exponent if s > 0 else 0.0 for s in shares]
    total = sum(raised)
    return [r / total for r in raised] if total else raised


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def bisect(low: float, high: float, holds: Callable[[float], bool], steps: int = 100) -> float:
    """The point of [low, high] nearest to low at which `holds` is true, if from some point on it is (high, if never)."""
    if holds(low):
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if holds(mid) else (mid, high)
    return high


def exponent_for_entropy(shares: list[float], target: float, steps: int = 100) -> float:
    """The exponent in [0, 64] whose tempered shares have the target entropy (the nearest where none has)."""
    return bisect(0.0, 64.0, lambda x: entropy(tempered(shares, x)) <= target, steps)


def blended(targets: list[float], shares: list[float], t: float) -> list[float]:
    """Geometric path from the targets (t = 0) to the shares (t = 1)."""
    raised = [a ** (1 - t) * b**t if a > 0 and b > 0 else 0.0 for a, b in zip(targets, shares)]
    total = sum(raised)
    return [r / total for r in raised] if total else raised


def plan(sources: list[Source], total: float | None = None) -> list[Source]:
    """Sets tempered, target and budget of each source. total None: the largest total at which the targets are feasible."""
    usable = [s for s in sources if s.n_tokens > 0 and s.weight > 0 and s.max_repeat > 0]
    if not usable:
        return sources
    norm, tokens = sum(s.weight for s in usable), sum(s.n_tokens for s in usable)
    targets, shares = [s.weight / norm for s in usable], [s.n_tokens / tokens for s in usable]
    most = [float(s.max_repeat * s.n_tokens) for s in usable]
    total = min(m / w for m, w in zip(most, targets)) if total is None else min(total, sum(most))

    def fits(weights: list[float]) -> bool:
        return all(w * total <= m * (1 + 1e-12) for w, m in zip(weights, most))

    exponent = exponent_for_entropy(shares, entropy(targets))
    even = tempered(shares, exponent)
    if fits(even) or fits(targets):
        # targets * (tempered / targets) ** left: what is left of the correction's full strength
        left = bisect(0.0, 1.0, lambda x: fits(blended(targets, even, x)))
        weights = blended(targets, even, left)
    else:
        step = bisect(0.0, 1.0, lambda x: fits(tempered(shares, exponent + x * (1.0 - exponent))))
        weights = tempered(shares, exponent + step * (1.0 - exponent))
    total = min(total, min(m / w for m, w in zip(most, weights) if w > 0))
    for s, e, w in zip(usable, even, weights):
        s.tempered, s.target, s.budget = e, w, w * total
    return sources


def measure(docs: DataFrame, targets: DataFrame) -> list[Source]:
    """The target sources with the documents and tokens they have: one small aggregate."""
    rows = targets.select("source", "weight", "max_repeat").where("source is not null").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES or len({r.source for r in rows}) < len(rows):
        raise ValueError("targets: too many sources, or one twice")
    sources = {r.source: Source(r.source, r.weight or 0.0, r.max_repeat or 0) for r in rows}
    found = docs.where("n_tokens > 0").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"), F.max("n_tokens").alias("m")).join(F.broadcast(targets.select("source")), "source", "left_semi")
    for r in found.collect():
        sources[r.source].n_docs, sources[r.source].n_tokens, sources[r.source].longest = r.n, r.t, r.m
    return list(sources.values())


def _permuted(docs: DataFrame, seed: int) -> DataFrame:
    """The documents with tokens, with their place in the permutation: two levels of blocks, the hash, the id."""
    h = F.xxhash64(F.lit(seed), F.col("source"), F.col("doc_id"))
    b2 = F.shiftrightunsigned(h, 64 - 2 * BITS).bitwiseAND((1 << BITS) - 1)
    return docs.where("n_tokens > 0").select("*", F.struct(F.shiftrightunsigned(h, 64 - BITS).alias("b1"), b2.alias("b2"), h.alias("h"), F.col("doc_id").alias("id")).alias("place"))


def _edges(d: DataFrame, rest: dict[str, float]) -> DataFrame:
    """source, last: the place of the last document of each source's part of a pass.

    Three small aggregates over ever fewer rows: the block in which the budget runs out, the block inside it, the
    document. What they hand on is one row a source.
    """
    spark = d.sparkSession
    left = spark.createDataFrame(list(rest.items()), "source string, rest double")
    at: list[str] = []
    for level in ("b1", "b2"):
        inside = d.join(F.broadcast(left), "source").where(F.expr(" and ".join(f"place.{x} = at_{x}" for x in at) or "true"))
        blocks = inside.groupBy("source", "rest", *[f"at_{x}" for x in at], F.col(f"place.{level}").alias(level)).agg(F.sum("n_tokens").alias("t"))
        before = F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy(level).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        edge = blocks.withColumn("before", before).where("before < rest").groupBy("source", *[f"at_{x}" for x in at]).agg(F.max(level).alias(f"at_{level}"), F.max_by(F.col("rest") - F.col("before"), level).alias("rest"))
        at.append(level)
        left = spark.createDataFrame(edge.collect(), edge.schema)  # at most MAX_SOURCES rows
    inside = d.join(F.broadcast(left), "source").where("place.b1 = at_b1 and place.b2 = at_b2")
    upto = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("place"))
    # the last document only if that comes nearer to the budget; none: the part ends before the block
    taken = inside.withColumn("upto", upto).where(F.col("upto") - F.col("n_tokens") / 2.0 <= F.col("rest")).groupBy("source").agg(F.max("place").alias("last"))
    kind = d.schema["place"].dataType.simpleString()
    start = F.struct(F.col("at_b1").alias("b1"), F.col("at_b2").alias("b2"), F.lit(None).cast("long").alias("h"), F.lit(None).cast(d.schema["doc_id"].dataType).alias("id")).cast(kind)
    return left.join(taken, "source", "left").select("source", F.coalesce("last", start).alias("last"))


def select(docs: DataFrame, sources: list[Source], seed: int = 1) -> DataFrame:
    """docs: doc_id, source, n_tokens. Result: doc_id, source, n_tokens, copies (at least 1). One pass over docs."""
    spark = docs.sparkSession
    rows, rest = [], {}
    for s in sources:
        if s.budget > 0:
            passes = min(s.max_repeat, int(s.budget / s.n_tokens + 1e-12))
            rows.append((s.name, passes))
            if passes < s.max_repeat and s.budget > passes * s.n_tokens:
                rest[s.name] = s.budget - passes * s.n_tokens
    d = _permuted(docs, seed)
    small = spark.createDataFrame(rows, "source string, passes int")
    kind = d.schema["place"].dataType
    small = small.join(_edges(d, rest), "source", "left") if rest else small.withColumn("last", F.lit(None).cast(kind))
    part = F.coalesce((F.col("place") <= F.col("last")).cast("int"), F.lit(0))
    out = d.join(F.broadcast(small), "source").select("doc_id", "source", "n_tokens", (F.col("passes") + part).alias("copies"))
    return out.where("copies > 0")


def report(selection: DataFrame, sources: list[Source]) -> DataFrame:
    """Per target source: what it has, its target and budget, what was used and the share actually reached."""
    spark = selection.sparkSession
    plan_rows = spark.createDataFrame([(s.name, s.weight, s.max_repeat, s.n_docs, s.n_tokens, s.longest, s.tempered, s.target, s.budget) for s in sources], "source string, weight double, max_repeat int, n_docs long, n_tokens long, longest long, tempered double, target double, budget double")
    used = selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.count("*").alias("used_docs"), F.max("copies").alias("most_copies"))
    total = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))
    return (
        plan_rows.join(used, "source", "left")
        .fillna(0, ["used_tokens", "used_docs", "most_copies"])
        .withColumn("actual", F.when(total > 0, F.col("used_tokens") / total).otherwise(F.lit(0.0)))
    )


def with_tokens(encoded: DataFrame) -> DataFrame:
    """encoded: doc_id, source, ids. Token counts, written once: the passes of select() read them again."""
    return materialize(encoded.select("doc_id", "source", F.size("ids").alias("n_tokens")), "tokens")
