"""The five rules over occurrences. Each gives one row for each hit, and counts; none ranks or judges.

Gap, frequency and cadence need no more than how many occurrences an item has on each day, so occurrences are counted by
day before they are shuffled: however often one item of one record occurs, its window holds no more rows than there are
days. Names are counted by spelling in the same way, and co-occurrence takes distinct days. All thresholds are checked before
a plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from tracewright.operators.matching import counted, named, named_counted, named_with_days

PAIR = ["record_seq", "key"]


def _whole(name: str, value: int, least: int) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{name} must be an integer of {least} or more, got {value!r}")


def _days(occ: DataFrame) -> DataFrame:
    """(record_seq, key, day, n): how often each item occurs on each day."""
    return occ.where("day is not null").groupBy(*PAIR, "day").agg(F.count("*").alias("n"))


def _with_names(hits: DataFrame, occ: DataFrame) -> DataFrame:
    return hits.join(named(occ), PAIR)


def recurrence(occ: DataFrame, min_count: int = 2) -> DataFrame:
    """(record_seq, key, record_id, item, count, dates, variants) of items with min_count occurrences or more, dated or not."""
    _whole("min_count", min_count, 1)
    each = occ.groupBy("record_seq", "key", "record_id", "original").agg(F.count("*").alias("n"), F.min(F.struct("date_str", "idx")).alias("first"), F.collect_list("date_str").alias("dates"))
    hits = each.groupBy(PAIR).agg(
        F.min("record_id").alias("record_id"),
        F.min_by("original", F.struct(-F.col("n"), "first")).alias("item"),
        F.sum("n").alias("count"),
        F.array_sort(F.flatten(F.collect_list("dates"))).alias("dates"),
        F.array_sort(F.collect_list("original")).alias("variants"),
    )
    return hits.where(F.col("count") >= min_count)


def gap(occ: DataFrame, gap_days: int = 90) -> DataFrame:
    """(record_seq, key, record_id, item, gap_days, before_date, after_date, variants): consecutive dated occurrences more
    than gap_days apart."""
    _whole("gap_days", gap_days, 0)
    last = F.greatest(F.size("days") - 1, F.lit(0))
    steps = F.zip_with(F.slice("days", 1, last), F.slice("days", 2, last), lambda a, b: F.struct(F.datediff(b, a).alias("gap"), a.alias("before"), b.alias("after")))
    hits = named_with_days(occ).select("*", F.explode_outer(F.filter(steps, lambda x: x["gap"] > gap_days)).alias("step")).where("step is not null")
    dates = (F.col(f"step.{x}").cast("string").alias(f"{x}_date") for x in ("before", "after"))
    return hits.select(*PAIR, F.col("step.gap").alias("gap_days"), *dates, "record_id", "item", "variants")


def frequency(occ: DataFrame, window_days: int = 30, min_count: int = 3) -> DataFrame:
    """(record_seq, key, record_id, item, count, window_start, window_end, dates, variants): of each item the fullest
    stretch of at most window_days between first and last occurrence, the earliest if several are as full."""
    _whole("window_days", window_days, 0)
    _whole("min_count", min_count, 2)
    number = F.unix_date("day")
    back = Over.partitionBy(*PAIR).orderBy(number).rangeBetween(-window_days, 0)
    rows = _days(occ).select(*PAIR, "day", F.col("n").alias("here"), F.sum("n").over(back).alias("n"), F.min("day").over(back).alias("low"))
    best = rows.groupBy(PAIR).agg(F.max_by(F.struct("low", "day", "n"), F.struct("n", -number)).alias("best"), F.array_sort(F.collect_list(F.struct("day", "here"))).alias("days"))
    best = best.where(F.col("best.n") >= min_count)
    inside = F.filter("days", lambda d: d["day"].between(F.col("best.low"), F.col("best.day")))
    dates = F.flatten(F.transform(inside, lambda d: F.array_repeat(d["day"].cast("string"), d["here"].cast("int"))))
    return _with_names(best.select(*PAIR, F.col("best.n").alias("count"), F.col("best.low").cast("string").alias("window_start"), F.col("best.day").cast("string").alias("window_end"), dates.alias("dates")), occ)


def _pairs_named(hits: DataFrame, each: DataFrame) -> DataFrame:
    """Both sides read the same columns of one table of names, so that it is worked out once."""
    names = named_counted(each)
    for side in ("a", "b"):
        hits = hits.join(names.select("record_seq", *(F.col(c).alias(f"{c}_{side}") for c in ("key", "record_id", "item", "variants"))), ["record_seq", f"key_{side}"])
    record_id = F.coalesce("record_id_a", "record_id_b").alias("record_id")
    return hits.select("record_seq", "key_a", "key_b", record_id, "item_a", "item_b", "count", "dates", "variants_a", "variants_b", "window_days", "pairs")


def _same_day(each: DataFrame) -> DataFrame:
    """(record_seq, key_a, key_b, date_str) of items that share a cited date."""
    cited = each.select("record_seq", "key", F.explode_outer(F.when(F.col("date_str") != "", F.array("date_str"))).alias("date_str")).where("date_str is not null")
    keys = cited.groupBy("record_seq", "date_str").agg(F.collect_set("key").alias("keys")).where(F.size("keys") > 1)
    first = keys.select("record_seq", "date_str", "keys", F.explode("keys").alias("key_a"))
    return first.select("record_seq", "key_a", "date_str", F.explode_outer(F.filter("keys", lambda k: k > F.col("key_a"))).alias("key_b")).where("key_b is not null")


def _near(each: DataFrame, window_days: int) -> DataFrame:
    """(record_seq, key_a, key_b, a, b): days of two items at most window_days apart.

    Records are dealt out in stretches of eight windows; days in a stretch's last window also go to the next, where later
    days look back on them. So a long record is spread and few days are doubled.
    """
    number, wide = F.unix_date("day").cast("long"), 8 * window_days
    stretches = F.array_distinct(F.array(*(F.floor((number + ahead) / wide) for ahead in (0, window_days))))
    dealt = each.select("record_seq", "key", "day", F.explode_outer(F.when(F.col("day").isNotNull(), stretches)).alias("stretch")).where("stretch is not null")
    back = Over.partitionBy("record_seq", "stretch").orderBy(number).rangeBetween(-window_days, 0)
    seen = dealt.withColumn("seen", F.collect_set(F.struct("key", "day")).over(back)).where(F.col("stretch") == F.floor(number / wide))
    pairs = seen.where(F.size("seen") > 1).select("record_seq", "key", "day", F.explode("seen").alias("other"))
    earlier = F.col("other.key") < F.col("key")
    pairs = pairs.where(earlier | (F.col("other.key") > F.col("key")) & (F.col("other.day") < F.col("day")))
    sides = {"key_a": ("other.key", "key"), "key_b": ("key", "other.key"), "a": ("other.day", "day"), "b": ("day", "other.day")}
    return pairs.select("record_seq", *(F.when(earlier, F.col(x)).otherwise(F.col(y)).alias(name) for name, (x, y) in sides.items()))


def cooccurrence(occ: DataFrame, min_count: int = 2, window_days: int = 0) -> DataFrame:
    """(record_seq, key_a, key_b, record_id, item_a, item_b, count, dates, variants_a, variants_b, window_days, pairs).

    window_days 0: pairs of items with min_count shared cited dates or more. Else: their days are matched one to one, the
    closest first (then the earlier on a's side, then on b's), at most window_days apart.
    """
    _whole("min_count", min_count, 1)
    _whole("window_days", window_days, 0)
    each = counted(occ)
    no_pairs = F.expr("cast(array() as array<struct<a: string, b: string, gap: int>>)")
    if window_days == 0:
        hits = _same_day(each).groupBy("record_seq", "key_a", "key_b").agg(F.count("*").alias("count"), F.array_sort(F.collect_list("date_str")).alias("dates"))
        hits = hits.where(F.col("count") >= min_count).withColumns({"window_days": F.lit(0), "pairs": no_pairs})
        return _pairs_named(hits, each)
    apart = F.abs(F.datediff("a", "b"))
    listed = _near(each, window_days).groupBy("record_seq", "key_a", "key_b").agg(F.array_sort(F.collect_set(F.struct(apart.alias("gap"), "a", "b"))).alias("all"))
    none = F.expr("named_struct('a', cast(array() as array<date>), 'b', cast(array() as array<date>))")
    both = lambda kept, x: F.struct(*(F.array_append(kept[s], x[s]).alias(s) for s in "ab"))
    taken = F.aggregate("all", none, lambda kept, x: F.when(F.array_contains(kept["a"], x["a"]) | F.array_contains(kept["b"], x["b"]), kept).otherwise(both(kept, x)))
    pairs = F.array_sort(F.zip_with("taken.a", "taken.b", lambda a, b: F.struct(a.cast("string").alias("a"), b.cast("string").alias("b"), F.abs(F.datediff(a, b)).alias("gap"))))
    hits = listed.where(F.size("all") >= min_count).withColumn("taken", taken).withColumn("pairs", pairs).withColumn("count", F.size("pairs").cast("long")).where(F.col("count") >= min_count)
    dates = F.array_sort(F.array_distinct(F.flatten(F.transform("pairs", lambda x: F.array(x["a"], x["b"])))))
    return _pairs_named(hits.select("record_seq", "key_a", "key_b", "count", dates.alias("dates"), F.lit(window_days).alias("window_days"), "pairs"), each)


def _ratio(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.greatest(a / b, b / a)).otherwise(0.0)


def cadence(occ: DataFrame, min_occurrences: int = 4, ratio: float = 2.0) -> DataFrame:
    """(record_seq, key, record_id, item, before_interval, after_interval, pivot_date, dates, variants).

    The intervals between an item's distinct days are split where Pettitt's rank statistic is largest (then the ratio of
    medians, then the earliest); a hit if the medians differ by `ratio` or more. The statistic is a running sum of each
    interval's rank balance (how many are shorter less how many are longer), so no pair of intervals is compared.
    """
    _whole("min_occurrences", min_occurrences, 2)
    if ratio < 1:
        raise ValueError(f"ratio must be 1 or more, got {ratio!r}")
    group = Over.partitionBy(*PAIR)
    order = group.orderBy("day")
    days = _days(occ).select(*PAIR, "day")
    steps = days.select(*PAIR, "day", F.lead("day").over(order).alias("next"), F.row_number().over(order).alias("k"), F.count("*").over(group).alias("n"))
    steps = steps.where((F.col("n") >= min_occurrences) & F.col("next").isNotNull()).withColumn("gap", F.datediff("next", "day"))
    size = group.orderBy("gap")
    steps = steps.withColumn("balance", F.rank().over(size) - 1 - (F.col("n") - 1 - F.count("*").over(size.rangeBetween(Over.unboundedPreceding, 0))))
    path = group.orderBy("k")
    past, future = path.rowsBetween(Over.unboundedPreceding, 0), path.rowsBetween(1, Over.unboundedFollowing)
    steps = steps.select(*PAIR, "k", "n", "next", F.abs(F.sum("balance").over(past)).alias("u"), F.percentile("gap", 0.5).over(past).alias("low"), F.percentile("gap", 0.5).over(future).alias("high"))
    steps = steps.where(F.col("k") < F.col("n") - 1).withColumn("ratio", _ratio(F.col("low"), F.col("high")))
    best = steps.groupBy(PAIR).agg(F.max_by(F.struct("low", "high", "ratio", "next"), F.struct("u", "ratio", -F.col("k"))).alias("best")).where((F.col("best.ratio") >= ratio) & (F.col("best.ratio") > 0))
    listed = days.groupBy(PAIR).agg(F.array_sort(F.collect_list(F.col("day").cast("string"))).alias("dates"))
    hits = best.select(*PAIR, F.bround("best.low").cast("long").alias("before_interval"), F.bround("best.high").cast("long").alias("after_interval"), F.col("best.next").cast("string").alias("pivot_date"))
    return _with_names(hits.join(listed, PAIR), occ)
