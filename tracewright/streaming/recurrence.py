"""Streams of dated mentions. An extension: the batch rules stay the reference for results.

Counts are exact whatever the order of arrival. Gaps need the order of days, so a late row could reopen one; the stream
therefore gives gaps only between days that the watermark has closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recurrence(rows: DataFrame, min_count: int = 2) -> DataFrame:
    """(record_id, key, count, first_date, last_date) of a stream (record_id, key, date_str), for output mode update: an
    item's row comes again whenever its count changes, from min_count on."""
    dated = F.when(F.col("date_str") != "", F.col("date_str"))
    counted = rows.groupBy("record_id", "key").agg(F.count("*").alias("count"), F.min(dated).alias("first_date"), F.max(dated).alias("last_date"))
    return counted.where(F.col("count") >= min_count)


def daily(rows: DataFrame, delay: str = "7 days") -> DataFrame:
    """(day, record_id, key, count) of a stream (record_id, key, ts), for output mode append: a day comes once, when the
    watermark has passed its end; later rows of that day are left out, as the delay says."""
    days = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "record_id", "key").agg(F.count("*").alias("count"))
    return days.select(F.col("w.start").cast("date").alias("day"), "record_id", "key", "count")
