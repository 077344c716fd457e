"""Data behind the pages: timelines, marked notes, cards; and the pages themselves as plain HTML."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import strict_date


def _escaped(text: Column) -> Column:
    """As html.escape does, quotes included."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def axis(occ: DataFrame) -> DataFrame:
    """(record_id, first, last) of records with two distinct days or more."""
    days = occ.where("day is not null").groupBy("record_id").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    return days.where("first < last")


def tick(day: Column, first: Column, last: Column) -> Column:
    """Where a day stands between two, in percent, 0 to 100; 50 if they are one."""
    return F.when(first == last, 50.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.datediff(day, first) / F.datediff(last, first) * 100.0)))


def hit_dates(found: DataFrame) -> DataFrame:
    """(record_id, item, date) of hits (record_id, item, dates), distinct; undated and unreal dates are left out."""
    rows = found.select("record_id", "item", F.explode("dates").alias("date")).distinct()
    return rows.where(strict_date(F.col("date")).isNotNull())


def ticks(found: DataFrame, bounds: DataFrame) -> DataFrame:
    """(record_id, item, date, percent): the timeline's rows."""
    rows = hit_dates(found).join(bounds, "record_id")
    return rows.select("record_id", "item", "date", tick(strict_date(F.col("date")), F.col("first"), F.col("last")).alias("percent"))


def spans(entries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, cls): item and date spans of entries, in order for each key."""
    item = entries.select(*keys, F.col("source_span")[0].alias("start"), F.col("source_span")[1].alias("end"), F.lit("item").alias("cls"))
    date = entries.where("date_span is not null").select(*keys, F.col("date_span")[0].alias("start"), F.col("date_span")[1].alias("end"), F.lit("date").alias("cls"))
    return item.unionByName(date).distinct()


def marked(notes: DataFrame, found: DataFrame) -> DataFrame:
    """(note_id, html): notes (note_id, text) escaped, with spans (note_id, start, end, cls) marked; a span that begins
    within an earlier one is skipped."""
    listed = found.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "cls"))).alias("spans"))
    rows = notes.join(listed, "note_id", "left").withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start: int, end: int, cls: string>>)")))
    zero = F.struct(F.lit("").alias("html"), F.lit(0).alias("at"))

    def step(done: Column, s: Column) -> Column:
        plain = _escaped(F.substring("text", done["at"] + 1, s["start"] - done["at"]))
        mark = F.concat(F.lit('<mark class="'), s["cls"], F.lit('">'), _escaped(F.substring("text", s["start"] + 1, s["end"] - s["start"])), F.lit("</mark>"))
        return F.when(s["start"] < done["at"], done).otherwise(F.struct(F.concat(done["html"], plain, mark).alias("html"), s["end"].cast("int").alias("at")))

    drawn = F.aggregate("spans", zero, step, lambda done: F.concat(done["html"], _escaped(F.substring("text", done["at"] + 1, F.length("text")))))
    return rows.select("note_id", drawn.alias("html"))


def anchor(record_id: Column) -> Column:
    """A record's id as a place to link to."""
    return F.concat(F.lit("rec-"), F.regexp_replace(record_id, "[^0-9A-Za-z_-]", "-"))


def cards(found: DataFrame) -> DataFrame:
    """(record_id, lens, item, chips, folded, card): hits (record_id, lens, item, dates, line) as cards; more than three
    dates are folded away."""
    chips = F.array_join(F.transform("dates", lambda d: F.concat(F.lit('<span class="chip">'), _escaped(d), F.lit("</span>"))), "")
    folded = F.size("dates") > 3
    body = F.when(folded, F.concat(F.format_string("<details><summary>%d dates</summary>", F.size("dates")), chips, F.lit("</details>"))).otherwise(chips)
    card = F.concat(F.lit('<article class="card"><h3>'), _escaped(F.col("item")), F.lit("</h3><p>"), _escaped(F.col("line")), F.lit("</p>"), body, F.lit("</article>"))
    return found.select("record_id", "lens", "item", F.size("dates").alias("chips"), folded.alias("folded"), card.alias("card"))


def pages(records: DataFrame, found: DataFrame, title: str) -> DataFrame:
    """(record_id, html): one page for each record (record_id, html of its note), with its lines (record_id, lens_ord,
    record_seq, hit_ord, lens, line); records without lines get a page too."""
    line = F.concat(F.lit('<li class="'), F.col("lens"), F.lit('">'), _escaped(F.col("line")), F.lit("</li>"))
    listed = found.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("lens_ord", "record_seq", "hit_ord", line.alias("li")))).alias("all"))
    rows = records.join(listed, "record_id", "left")
    lines = F.coalesce(F.array_join(F.transform("all", lambda x: x["li"]), ""), F.lit(""))
    head = f"<!doctype html><html><head><meta charset=\"utf-8\"><title>{html.escape(title)}</title></head><body>"
    return rows.select("record_id", F.concat(F.lit(head), F.lit('<section id="'), anchor(F.col("record_id")), F.lit('"><h2>'), _escaped(F.col("record_id")), F.lit("</h2><pre>"), "html", F.lit("</pre><ul>"), lines, F.lit("</ul></section></body></html>")).alias("html"))


def refused(rows: DataFrame) -> DataFrame:
    """(note_id, index, line) of refused segments, for a page's last section."""
    return rows.select("note_id", "index", F.format_string("segment %d: %s at %d (%s)", "index", "reason", "char_offset", "detail").alias("line"))
