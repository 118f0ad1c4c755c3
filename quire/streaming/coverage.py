"""Streaming form of the coverage roll-up: hits per book and day, late hits included up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_hits(hits: DataFrame, late: str = "7 days") -> DataFrame:
    """book_id, day, n_hits of a stream of search hits (book_id, hit_at).

    A repeat of a hit (run_id, rank_no) within the watermark counts once. Append mode: a day is final when
    the watermark has passed it. State: the open days of the books seen, and the hits of the watermark.
    """
    h = hits.withColumn("hit_at", F.col("hit_at").cast("timestamp")).withWatermark("hit_at", late)
    one = h.dropDuplicatesWithinWatermark(["run_id", "rank_no"])
    return one.groupBy(F.window("hit_at", "1 day").alias("w"), "book_id").agg(F.count("*").alias("n_hits")).select("book_id", F.col("w.start").alias("day"), "n_hits")
