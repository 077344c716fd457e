from pyspark.sql import functions as F

from tracewright.streaming import recurrence as stream


def run(spark, frame, mode, name):
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        query.processAllAvailable()
        return spark.table(name).collect()
    finally:
        query.stop()


def test_streamed_counts_equal_the_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").cast("string").alias("record_id"), F.col("event_type").alias("key"), "ts").withColumn("date_str", F.date_format("ts", "yyyy-MM-dd"))
    for k in range(3):
        rows.where(F.pmod(F.hash("ts"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    latest = {}
    for r in run(spark, stream.recurrence(source()), "update", "counts"):
        latest[r.record_id, r.key] = max(latest.get((r.record_id, r.key), (0,)), (r["count"], r.first_date, r.last_date))
    want = rows.groupBy("record_id", "key").agg(F.count("*").alias("n"), F.min("date_str").alias("a"), F.max("date_str").alias("b")).where("n >= 2").collect()
    assert latest == {(r.record_id, r.key): (r.n, r.a, r.b) for r in want}
    days = run(spark, stream.daily(source(), "60 days"), "append", "days")
    assert all(r["count"] >= 1 for r in days)
