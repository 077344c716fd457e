"""Sources of records and of rows for the matching core: nested tables, dirty JSON lines, and plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.text import iso


def nested(records: DataFrame, order: str | None = None) -> DataFrame:
    """records (id, entries, ...) with record_seq: `order`, a column that identifies each record, or a number given once
    and written down by the caller (it is stable only within one plan)."""
    return records.withColumn("record_seq", F.col(order) if order else F.monotonically_increasing_id())


def json_lines(spark: SparkSession, path: str, field: str = "item") -> DataFrame:
    """(record_seq, id, entries) of one JSON record a line. What isn't an object, a list of entries or an entry is left
    out and never raises; values of other types are taken as strings. record_seq numbers the lines in the order in which Spark
    reads them: the same for the same files and settings, not beyond; write it down where it must last."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("record_seq"))
    value = F.try_parse_json("value")
    records = lines.select("record_seq", value.alias("v"))
    entries = F.try_variant_get("v", "$.entries", "array<variant>")
    entry = F.transform(
        F.coalesce(entries, F.array().cast("array<variant>")),
        lambda e: F.struct(F.try_variant_get(e, "$.date", "string").alias("date"), F.try_variant_get(e, f"$.{field}", "string").alias(field)),
    )
    return records.select("record_seq", F.coalesce(F.try_variant_get("v", "$.id", "string"), F.lit("")).alias("id"), entry.alias("entries"))


def rows(table: DataFrame, record: str, item: str, date: str, tie: str | Column) -> DataFrame:
    """(record_seq, record_id, original, date_str, idx) of a plain table: one row is one entry, `record` identifies the
    record, `tie` orders entries of one day. Days of timestamps are taken in the session's time zone."""
    day = F.col(date).cast("date")
    return table.where(F.col(record).isNotNull() & F.col(item).isNotNull() & (F.col(item) != "")).select(
        F.col(record).cast("long").alias("record_seq"),
        F.col(record).cast("string").alias("record_id"),
        F.col(item).cast("string").alias("original"),
        F.coalesce(iso(day), F.lit("")).alias("date_str"),
        (F.col(tie) if isinstance(tie, str) else tie).cast("long").alias("idx"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "event_type", "ts", "event_id")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey")


def shipped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' parts by type and ship date: lineitem with orders and part."""
    line, order, part = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "part"))
    line = line.select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate")
    both = line.join(order.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return rows(both, "o_custkey", "p_type", "l_shipdate", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


def notes_of(table: DataFrame, header: str = "Patient: ") -> DataFrame:
    """(note_id, text): of rows (record_seq, record_id, original, date_str, idx), each record as a note with a header line
    and one dated line an entry, in the order of date and tie."""
    listed = F.array_sort(F.collect_list(F.struct("date_str", "idx", "original")))
    lines = F.transform(listed, lambda x: F.concat_ws(" ", x["date_str"], x["original"]))
    return table.groupBy("record_seq").agg(F.min("record_id").alias("record_id"), lines.alias("lines")).select(F.col("record_seq").alias("note_id"), F.concat(F.lit(header), F.col("record_id"), F.lit("\n\n"), F.array_join("lines", "\n"), F.lit("\n")).alias("text"))
