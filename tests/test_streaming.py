from datetime import datetime

from quire.streaming.coverage import daily_hits


def test_daily_hits(spark, tmp_path):
    rows = [(1, 1, 7, datetime(2024, 1, 1, 10)), (1, 1, 7, datetime(2024, 1, 1, 10)), (1, 2, 7, datetime(2024, 1, 1, 11)), (2, 1, 8, datetime(2024, 1, 2, 0)), (3, 1, 8, datetime(2024, 3, 1, 0))]
    df = spark.createDataFrame(rows, "run_id bigint, rank_no int, book_id int, hit_at timestamp_ntz")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = daily_hits(stream).writeStream.format("memory").queryName("daily").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.book_id, r.day.date().isoformat(), r.n_hits) for r in spark.table("daily").collect()}
    assert got == {(7, "2024-01-01", 2), (8, "2024-01-02", 1)}
