"""Per-key results when a few keys hold most records.

Multi-level tree aggregation: fixed-size chunks of the input are combined where they lie, and the partial
states of a key are then merged in rounds of logarithmic fan-in. No reducer ever receives all partials of
a hot key: in each round a (key, node) group holds about fan_in states.

Defined results: null keys form a group of their own; an empty input gives no rows; nulls in a measured
column are ignored by min, max and sum (all null: null) and not counted by count(column); repeated rows
all count; a measured column may share its name with a key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a state made by the first function is merged.
_MERGE = {"count": "sum", "sum": "sum", "min": "min", "max": "max"}


def rounds_for(chunks: int, fan_in: int) -> int:
    """Rounds that bring so many chunks down to one node."""
    return max(1, math.ceil(math.log(max(2, chunks), fan_in)))


def tree_aggregate(df: DataFrame, keys: dict[str, Column], measures: dict[str, tuple[str, Column]], chunk_rows: int = 1 << 17, fan_in: int = 16, rows: int | None = None, rounds: int | None = None) -> DataFrame:
    """keys: output name to expression. measures: output name to (count | sum | min | max, expression).

    rows: the number of rows if known; else it is counted, which for a stored table reads its footers only.
    """
    if rounds is None:
        rounds = rounds_for(math.ceil((df.count() if rows is None else rows) / chunk_rows) + df.sparkSession.sparkContext.defaultParallelism, fan_in)
    # the id counts rows within a partition in its low 33 bits, so this is the chunk a row lies in
    row = F.monotonically_increasing_id()
    leaf = F.pmod(F.xxhash64(F.shiftright(row, 33), F.floor(row.bitwiseAND((1 << 33) - 1) / chunk_rows)), F.lit(fan_in**rounds))
    state = df.select(*[e.alias(f"k_{n}") for n, e in keys.items()], *[e.alias(f"m_{n}") for n, (_, e) in measures.items()], leaf.alias("node"))
    names = [f"k_{n}" for n in keys]
    state = state.groupBy(*names, "node").agg(*[getattr(F, how)(f"m_{n}").alias(f"m_{n}") for n, (how, _) in measures.items()])
    for _ in range(rounds):
        state = state.withColumn("node", F.floor(F.col("node") / fan_in)).groupBy(*names, "node").agg(*[getattr(F, _MERGE[how])(f"m_{n}").alias(f"m_{n}") for n, (how, _) in measures.items()])
    return state.select(*[F.col(f"k_{n}").alias(n) for n in keys], *[F.col(f"m_{n}").alias(n) for n in measures])


def tree_distinct_count(df: DataFrame, keys: dict[str, Column], value: Column, name: str, fan_in: int = 16, rows: int | None = None) -> DataFrame:
    """Distinct non-null values per key: equal (key, value) pairs meet first, spread by both, then counts by tree.

    rows: the number of rows of df if known, which bounds that of the pairs and so gives the rounds.
    """
    pairs = df.select(*[e.alias(n) for n, e in keys.items()], value.alias("v__")).where("v__ is not null").distinct()
    return tree_aggregate(pairs, {n: F.col(n) for n in keys}, {name: ("count", F.col("v__"))}, fan_in=fan_in, rows=df.count() if rows is None else rows)


def heavy_keys(df: DataFrame, key: str, percent: int) -> DataFrame:
    """Non-null keys that hold more than `percent` of all rows (rows with a null key count in the total)."""
    total = df.count()
    counts = tree_aggregate(df, {"key": F.col(key)}, {"n": ("count", F.lit(1))}, rows=total)
    return counts.where(F.col("key").isNotNull() & (F.col("n") * 100 > F.lit(percent * total))).select("key", "n")
