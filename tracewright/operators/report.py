"""Hits as cited lines, and the combined report of each record.

The registry of lenses is ordered; a lens is a name, a rule from occurrences to hits, and a line for a hit. Lines list and
cite, and never score or rank. A report merges the records that share an id, in the order of the lenses, then of the
records, then of each rule.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators import rules

#: What lines say.
LINES = {
    "recurrence": '"%s" recurred %d times — %s',
    "gap": '"%s" returned after %d days — last seen %s, then %s',
    "frequency": '"%s" appeared %d times within %d days — %s',
    "cooccurrence": '"%s" + "%s" co-occurred %d times — %s',
    "cooccurrence-window": '"%s" + "%s" co-occurred %d times within %d days — %s',
    "cadence-change": '"%s" interval changed from ~%dd to ~%dd at %s — %s',
    "undated": "(undated)",
    "merged": " [merged: %s]",
    "record": "Record %s:",
    "finding": "  [%s] %s",
}


def _merged(variants: Column) -> Column:
    quoted = F.array_join(F.transform(variants, lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ", ")
    return F.when(F.size(variants) > 1, F.format_string(LINES["merged"], quoted)).otherwise("")


def _dates(dates: Column) -> Column:
    return F.array_join(F.transform(dates, lambda d: F.when(d == "", LINES["undated"]).otherwise(d)), ", ")


def recurrence_line() -> Column:
    return F.concat(F.format_string(LINES["recurrence"], "item", "count", _dates(F.col("dates"))), _merged(F.col("variants")))


def gap_line() -> Column:
    return F.concat(F.format_string(LINES["gap"], "item", "gap_days", "before_date", "after_date"), _merged(F.col("variants")))


def frequency_line() -> Column:
    days = F.datediff(F.col("window_end").cast("date"), F.col("window_start").cast("date"))
    return F.concat(F.format_string(LINES["frequency"], "item", "count", days, F.array_join("dates", ", ")), _merged(F.col("variants")))


def cooccurrence_line() -> Column:
    listed = F.array_join(F.transform("pairs", lambda p: F.format_string("(%s ~ %s: %dd)", p["a"], p["b"], p["gap"])), ", ")
    within = F.format_string(LINES["cooccurrence-window"], "item_a", "item_b", "count", "window_days", listed)
    same = F.format_string(LINES["cooccurrence"], "item_a", "item_b", "count", F.array_join("dates", ", "))
    merged = [F.when(F.size(f"variants_{s}") > 1, F.concat(F.format_string(' "%s"', f"item_{s}"), _merged(F.col(f"variants_{s}")))).otherwise("") for s in "ab"]
    return F.concat(F.when(F.col("window_days") > 0, within).otherwise(same), *merged)


def cadence_line() -> Column:
    return F.concat(F.format_string(LINES["cadence-change"], "item", "before_interval", "after_interval", "pivot_date", F.array_join("dates", ", ")), _merged(F.col("variants")))


@dataclass(frozen=True)
class Lens:
    """order: the columns of a hit that follow record_seq in the rule's own order."""

    name: str
    rule: Callable[[DataFrame], DataFrame]
    line: Callable[[], Column]
    order: tuple[str, ...]


LENSES = (
    Lens("recurrence", rules.recurrence, recurrence_line, ("key",)),
    Lens("gap", rules.gap, gap_line, ("key", "before_date", "after_date")),
    Lens("frequency", rules.frequency, frequency_line, ("key",)),
    Lens("co-occurrence", rules.cooccurrence, cooccurrence_line, ("key_a", "key_b")),
    Lens("cadence-change", rules.cadence, cadence_line, ("key",)),
)


def findings(occ: DataFrame, lenses: tuple[Lens, ...] = LENSES) -> DataFrame:
    """(record_id, lens_ord, lens, record_seq, hit_ord, line) of all lenses at their default thresholds. hit_ord sorts hits
    of one record and lens."""
    parts = []
    for at, lens in enumerate(lenses):
        hits = lens.rule(occ)
        order = F.array(*(F.col(c) for c in lens.order))
        parts.append(hits.select("record_id", F.lit(at).alias("lens_ord"), F.lit(lens.name).alias("lens"), "record_seq", order.alias("hit_ord"), lens.line().alias("line")))
    return reduce(DataFrame.unionByName, parts)


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy("record_id", "lens_ord", "record_seq", "hit_ord")


def with_record(line: Column) -> Column:
    """A line on its own, with the record it is from."""
    return F.format_string("Record %s: %s", F.col("record_id"), line)


def blocks(found: DataFrame) -> DataFrame:
    """(record_id, block): the report's text for each record with findings."""
    one = F.struct("lens_ord", "record_seq", "hit_ord", F.format_string(LINES["finding"], "lens", "line").alias("text"))
    listed = found.groupBy("record_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    return listed.select("record_id", F.concat_ws("\n", F.format_string(LINES["record"], "record_id"), F.array_join(F.transform("all", lambda x: x["text"]), "\n")).alias("block"))


def text(found: DataFrame) -> str:
    """The whole report, records by id, for small results."""
    return "\n\n".join(r["block"] for r in blocks(found).orderBy("record_id").toLocalIterator())


def lens_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("lens").agg(F.count("*").alias("n"))
