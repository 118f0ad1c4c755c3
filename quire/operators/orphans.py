"""References to records that do not exist, were withdrawn, or arrive later.

Parents and children are laid out in one long form (target table, key, tag); grouping by target and key
with map-side combine leaves one row per key, with the time from which a valid parent stands. Keys without
that flag, or whose first child is older than it, are kept, with the number of their children; only their children
are read again. The keys with more than 1 / HOT of these children are fewer than HOT, so they are known to every
task, and their children are spread over as many salts as their number asks for: a key that a third of all rows
refer to is a third of all tasks, at any size.

Defined results: a reference with a null part refers to nothing; a parent counts from its loaded_at if its
deleted_at is null; a null loaded_at of a parent never satisfies a child, a null loaded_at of a child is
satisfied by any valid parent; repeated rows of a record are one case; an empty parent table makes every
reference a case.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.runtime import materialize

#: A key with more than one in HOT of the lacking keys' children is spread; fewer than HOT keys can be.
HOT = 1000


@dataclass
class Reference:
    """rows: the referring table; rec_id: its record; key: the columns that refer; at: when it was loaded."""

    tbl: str
    field: str
    target: str
    rows: DataFrame
    rec_id: Column
    key: list[Column]
    at: Column


@dataclass
class Target:
    name: str
    rows: DataFrame
    key: list[Column]
    valid: Column
    at: Column


def _key(parts: list[Column]) -> Column:
    """Parts joined by a separator that integers and names do not hold; null if any part is null."""
    return reduce(lambda a, b: F.concat(a, F.lit("\x1f"), b), [p.cast("string") for p in parts])


def orphans(references: list[Reference], targets: list[Target], hot: int = HOT) -> DataFrame:
    """Stored rows whose target is absent: tbl, field, target, rec_id, key, at."""
    children = reduce(
        DataFrame.unionByName,
        [r.rows.select(F.lit(r.tbl).alias("tbl"), F.lit(r.field).alias("field"), F.lit(r.target).alias("target"), r.rec_id.cast("long").alias("rec_id"), _key(r.key).alias("key"), r.at.alias("at")).where("key is not null") for r in references],
    )
    parents = reduce(DataFrame.unionByName, [t.rows.where(t.valid).select(F.lit(t.name).alias("target"), _key(t.key).alias("key"), t.at.alias("at")).where("key is not null") for t in targets])
    tagged = parents.select("target", "key", F.col("at").alias("parent_at"), F.lit(None).cast("timestamp_ntz").alias("child_at"), F.lit(0).alias("child")).unionByName(
        children.select("target", "key", F.lit(None).cast("timestamp_ntz").alias("parent_at"), F.col("at").alias("child_at"), F.lit(1).alias("child"))
    )
    lacking = (
        tagged.groupBy("target", "key")
        .agg(F.min("parent_at").alias("parent_at"), F.min("child_at").alias("first_child"), F.sum("child").alias("n"))
        .where("n > 0 and (parent_at is null or first_child < parent_at)")
        .select("target", "key", "parent_at", "n")
    )
    lacking = materialize(lacking, "lacking")  # read for the total, the hot keys and the join
    total = lacking.agg(F.sum("n")).first()[0] or 0
    share = total // hot + 1
    spread = lacking.where(F.col("n") > share).select("target", "key", F.ceil(F.col("n") / share).cast("int").alias("salts"))
    if spread.isEmpty():
        salted = lacking.drop("n")
        on = ["target", "key"]
    else:
        of = F.pmod(F.xxhash64("rec_id", "at"), F.coalesce("salts", F.lit(1))).cast("int")
        children = children.join(F.broadcast(spread), ["target", "key"], "left").withColumn("salt", of)  # fewer than `hot` rows
        salted = lacking.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > share, F.ceil(F.col("n") / share).cast("int") - 1).otherwise(0)))).drop("n")
        on = ["target", "key", "salt"]
    return children.join(salted, on).where("parent_at is null or at < parent_at").select("tbl", "field", "target", "rec_id", "key", "at")


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphan records and distinct missing keys per referring table, field and month of loaded_at."""
    by_key = found.withColumn("month", F.date_format("at", "yyyy-MM")).groupBy("tbl", "field", "target", "month", "key").agg(F.count_distinct("rec_id").alias("n"))
    return by_key.groupBy("tbl", "field", "target", "month").agg(F.sum("n").alias("n_orphans"), F.count("*").alias("n_keys"))
