"""The registry of queries over the driver's tables, and their equivalents in SQL.

Tables of the driver carry the operators: events (user, event type, day), orders and shipped items as records; notes are
written from events; documents are scanned. SQL equivalents state the rules anew and share no code with the operators.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from tracewright.operators import audit, extract, report, rules, sensitive, views
from tracewright.operators.matching import Matching, named, occurrences, unnested
from tracewright.sources import records as sources

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


def _joined(column: str) -> Column:
    return F.array_join(column, ", ").alias(column)


# SQL of the adapters: seq, item, day, idx

_EVENTS = "select user_id as seq, event_type as item, cast(ts as date) as day, event_id as idx from events"
_ORDERS = "select o_custkey as seq, o_orderpriority as item, cast(o_orderdate as date) as day, o_orderkey as idx from orders"
_ITEMS = "select o_custkey as seq, p_type as item, cast(l_shipdate as date) as day, l_orderkey * 10 + l_linenumber as idx from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences(sources.events(spark, sf_dir))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences(sources.orders(spark, sf_dir))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences(sources.shipped_items(spark, sf_dir))


# recurrence


def _recurrence_sql(rows: str, least: int) -> str:
    return f"""select cast(seq as varchar) as record_id, item, count(*) as n, string_agg(cast(day as varchar), ', ' order by day) as dates, item as variants
        from ({rows}) group by seq, item having count(*) >= {least}"""


def _recurrence(occ: DataFrame, least: int) -> DataFrame:
    return rules.recurrence(occ, least).select("record_id", "item", F.col("count").alias("n"), _joined("dates"), _joined("variants"))


@query(_recurrence_sql(_EVENTS, 2))
def recurrence_events(spark, sf_dir):
    return _recurrence(_events(spark, sf_dir), 2)


@query(_recurrence_sql(_ORDERS, 3))
def recurrence_orders_min3(spark, sf_dir):
    return _recurrence(_orders(spark, sf_dir), 3)


@query(_recurrence_sql(_ITEMS, 2))
def recurrence_items(spark, sf_dir):
    return _recurrence(_items(spark, sf_dir), 2)


# gap


def _gap_sql(rows: str, days: int) -> str:
    return f"""select cast(seq as varchar) as record_id, item, cast(day - last as bigint) as gap_days, cast(last as varchar) as before_date, cast(day as varchar) as after_date
        from (select seq, item, day, lag(day) over (partition by seq, item order by day, idx) as last from ({rows})) where day - last > {days}"""


def _gap(occ: DataFrame, days: int) -> DataFrame:
    return rules.gap(occ, days).select("record_id", "item", F.col("gap_days").cast("long").alias("gap_days"), "before_date", "after_date")


@query(_gap_sql(_ORDERS, 90))
def gap_orders_90(spark, sf_dir):
    return _gap(_orders(spark, sf_dir), 90)


@query(_gap_sql(_EVENTS, 7))
def gap_events_7(spark, sf_dir):
    return _gap(_events(spark, sf_dir), 7)


@query(_gap_sql(_ITEMS, 365))
def gap_items_365(spark, sf_dir):
    return _gap(_items(spark, sf_dir), 365)


# frequency


def _burst_sql(rows: str, days: int, least: int) -> str:
    return f"""with r as ({rows}),
        w as (select seq, item, day, count(*) over s as n, min(day) over s as low from r
            window s as (partition by seq, item order by day range between interval {days} day preceding and current row)),
        b as (select seq, item, day, low, n from (select *, row_number() over (partition by seq, item order by n desc, day) as k from w) where k = 1 and n >= {least})
        select cast(b.seq as varchar) as record_id, b.item, any_value(b.n) as n, cast(any_value(b.low) as varchar) as window_start, cast(any_value(b.day) as varchar) as window_end,
            string_agg(cast(r.day as varchar), ', ' order by r.day) as dates
        from b join r on r.seq = b.seq and r.item = b.item and r.day between b.low and b.day group by b.seq, b.item"""


def _burst(occ: DataFrame, days: int, least: int) -> DataFrame:
    return rules.frequency(occ, days, least).select("record_id", "item", F.col("count").alias("n"), "window_start", "window_end", _joined("dates"))


@query(_burst_sql(_EVENTS, 7, 5))
def burst_events_7d5(spark, sf_dir):
    return _burst(_events(spark, sf_dir), 7, 5)


@query(_burst_sql(_ITEMS, 30, 3))
def burst_items_30d3(spark, sf_dir):
    return _burst(_items(spark, sf_dir), 30, 3)


@query(_burst_sql(_ORDERS, 30, 3))
def burst_orders_30d3(spark, sf_dir):
    return _burst(_orders(spark, sf_dir), 30, 3)


# co-occurrence


def _same_day_sql(rows: str, least: int) -> str:
    return f"""with d as (select distinct seq, item, day from ({rows}))
        select cast(a.seq as varchar) as record_id, a.item as item_a, b.item as item_b, count(*) as n, string_agg(cast(a.day as varchar), ', ' order by a.day) as dates
        from d a join d b on a.seq = b.seq and a.day = b.day and a.item < b.item group by a.seq, a.item, b.item having count(*) >= {least}"""


def _same_day(occ: DataFrame, least: int) -> DataFrame:
    return rules.cooccurrence(occ, least).select("record_id", "item_a", "item_b", F.col("count").alias("n"), _joined("dates"))


def _within_sql(rows: str, days: int, least: int) -> str:
    return f"""with d as (select distinct seq, item, day from ({rows})),
        c as (select a.seq, a.item as item_a, b.item as item_b, list({{'g': abs(a.day - b.day), 'a': cast(a.day as varchar), 'b': cast(b.day as varchar)}} order by abs(a.day - b.day), a.day, b.day) as l
            from d a join d b on a.seq = b.seq and a.item < b.item and abs(a.day - b.day) <= {days} group by a.seq, a.item, b.item),
        m as (select seq, item_a, item_b, list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: case when len(list_filter(acc, lambda k: k.a = x[1].a or k.b = x[1].b)) > 0 then acc else list_concat(acc, x) end) as l from c)
        select cast(seq as varchar) as record_id, item_a, item_b, cast(len(l) as bigint) as n, cast(list_sum(list_transform(l, lambda x: x.g)) as bigint) as days_apart,
            array_to_string(list_sort(list_transform(l, lambda x: x.a || ' ~ ' || x.b || ': ' || x.g)), ', ') as pairs from m where len(l) >= {least}"""


def _within(occ: DataFrame, days: int, least: int) -> DataFrame:
    apart = F.aggregate("pairs", F.lit(0).cast("long"), lambda s, p: s + p["gap"])
    pairs = F.array_join(F.transform("pairs", lambda p: F.concat(p["a"], F.lit(" ~ "), p["b"], F.lit(": "), p["gap"].cast("string"))), ", ")
    return rules.cooccurrence(occ, least, days).select("record_id", "item_a", "item_b", F.col("count").alias("n"), apart.alias("days_apart"), pairs.alias("pairs"))


@query(_same_day_sql(_EVENTS, 2))
def cooc_events_same_day(spark, sf_dir):
    return _same_day(_events(spark, sf_dir), 2)


@query(_same_day_sql(_ITEMS, 2))
def cooc_items_same_day(spark, sf_dir):
    return _same_day(_items(spark, sf_dir), 2)


@query(_within_sql(_EVENTS, 2, 8))
def cooc_events_window(spark, sf_dir):
    return _within(_events(spark, sf_dir), 2, 8)


@query(_within_sql(_ITEMS, 7, 2))
def cooc_items_window(spark, sf_dir):
    return _within(_items(spark, sf_dir), 7, 2)


# cadence


def _cadence_sql(rows: str) -> str:
    return f"""with d as (select distinct seq, item, day from ({rows})),
        g as (select seq, item, day, lead(day) over w as next, row_number() over w as k, count(*) over (partition by seq, item) as n from d window w as (partition by seq, item order by day)),
        v as (select seq, item, k, n, next, cast(next - day as bigint) as gap from g where next is not null and n >= 4),
        s as (select a.seq, a.item, a.k, sum(case when a.gap > b.gap then 1 when a.gap < b.gap then -1 else 0 end) as balance from v a join v b on a.seq = b.seq and a.item = b.item group by a.seq, a.item, a.k),
        u as (select v.seq, v.item, v.k, v.n, v.next, abs(sum(s.balance) over (partition by v.seq, v.item order by v.k)) as u,
                quantile_cont(v.gap, 0.5) over (partition by v.seq, v.item order by v.k rows between unbounded preceding and current row) as low,
                quantile_cont(v.gap, 0.5) over (partition by v.seq, v.item order by v.k rows between 1 following and unbounded following) as high
            from v join s on v.seq = s.seq and v.item = s.item and v.k = s.k),
        r as (select *, case when low > 0 and high > 0 then greatest(low / high, high / low) else 0 end as ratio from u where k < n - 1),
        b as (select *, row_number() over (partition by seq, item order by u desc, ratio desc, k) as place from r)
        select cast(seq as varchar) as record_id, item, cast(round_even(low, 0) as bigint) as before_interval, cast(round_even(high, 0) as bigint) as after_interval, cast(next as varchar) as pivot_date
        from b where place = 1 and ratio >= 2"""


def _cadence(occ: DataFrame) -> DataFrame:
    return rules.cadence(occ).select("record_id", "item", "before_interval", "after_interval", "pivot_date")


@query(_cadence_sql(_EVENTS))
def cadence_events(spark, sf_dir):
    return _cadence(_events(spark, sf_dir))


@query(_cadence_sql(_ORDERS))
def cadence_orders(spark, sf_dir):
    return _cadence(_orders(spark, sf_dir))


@query(_cadence_sql(_ITEMS))
def cadence_items(spark, sf_dir):
    return _cadence(_items(spark, sf_dir))


# the combined report


@query(
    f"""select 'recurrence' as lens, count(*) as n from ({_recurrence_sql(_EVENTS, 2)}) union all
    select 'frequency', count(*) from ({_burst_sql(_EVENTS, 30, 3)}) union all
    select 'co-occurrence', count(*) from ({_same_day_sql(_EVENTS, 2)}) union all
    select 'cadence-change', count(*) from ({_cadence_sql(_EVENTS)})"""
)
def report_lens_counts(spark, sf_dir):
    """No user's events are 90 days apart, so the lens gap has no row."""
    return report.lens_counts(report.findings(_events(spark, sf_dir)))


_LINES_OF_EVENTS = f"""select record_id, 0 as lens_ord, item as place, 'recurrence' as lens, '"' || item || '" recurred ' || n || ' times — ' || dates as line from ({_recurrence_sql(_EVENTS, 2)}) union all
    select record_id, 2, item, 'frequency', '"' || item || '" appeared ' || n || ' times within ' || (cast(window_end as date) - cast(window_start as date)) || ' days — ' || dates from ({_burst_sql(_EVENTS, 30, 3)}) union all
    select record_id, 3, item_a || ' ' || item_b, 'co-occurrence', '"' || item_a || '" + "' || item_b || '" co-occurred ' || n || ' times — ' || dates from ({_same_day_sql(_EVENTS, 2)}) union all
    select record_id, 4, item, 'cadence-change', '"' || item || '" interval changed from ~' || before_interval || 'd to ~' || after_interval || 'd at ' || pivot_date || ' — ' || dates from ({_cadence_sql(_EVENTS)})
        join (select cast(seq as varchar) as record_id, item, string_agg(cast(day as varchar), ', ' order by day) as dates from (select distinct seq, item, day from ({_EVENTS})) group by seq, item) using (record_id, item)"""


@query(f"select record_id, lens, line from ({_LINES_OF_EVENTS})")
def report_lines_events(spark, sf_dir):
    """No user's events are 90 days apart, so the lens gap has no line."""
    return report.findings(_events(spark, sf_dir)).select("record_id", "lens", "line")


@query(
    f"""select record_id, 'Record ' || record_id || ':' || chr(10) || string_agg('  [gap] "' || item || '" returned after ' || gap_days || ' days — last seen ' || before_date || ', then ' || after_date, chr(10) order by item, before_date) as block
    from ({_gap_sql(_ORDERS, 90)}) group by record_id"""
)
def report_blocks_gaps(spark, sf_dir):
    return report.blocks(report.findings(_orders(spark, sf_dir), tuple(x for x in report.LENSES if x.name == "gap")))


@query(f"select record_id, 'Record ' || record_id || ':' || chr(10) || string_agg('  [' || lens || '] ' || line, chr(10) order by lens_ord, place) as block from ({_LINES_OF_EVENTS}) group by record_id")
def report_blocks_events(spark, sf_dir):
    return report.blocks(report.findings(_events(spark, sf_dir)))


# matching


_MANGLED = "case event_id % 4 when 0 then event_type when 1 then upper(event_type) when 2 then '  ' || event_type || ' ' else upper(substr(event_type, 1, 1)) || substr(event_type, 2) end"


def _mangled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in four spellings by the event's number."""
    kind = F.col("event_type")
    first = F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, 2, 100))
    spelt = F.when(F.col("event_id") % 4 == 0, kind).when(F.col("event_id") % 4 == 1, F.upper(kind)).when(F.col("event_id") % 4 == 2, F.concat(F.lit("  "), kind, F.lit(" "))).otherwise(first)
    table = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("event_type", spelt)
    return sources.rows(table, "user_id", "event_type", "ts", "event_id")


@query(
    f"""with r as (select user_id, event_type as key, {_MANGLED} as spelt, cast(ts as date) as day, event_id from events),
    e as (select user_id, key, spelt, count(*) as n, min(cast(day as varchar) || lpad(cast(event_id as varchar), 20, '0')) as first from r group by user_id, key, spelt),
    l as (select user_id, key, spelt from (select *, row_number() over (partition by user_id, key order by n desc, first) as k from e) where k = 1)
    select cast(e.user_id as varchar) as record_id, e.key, any_value(l.spelt) as item, cast(sum(e.n) as bigint) as n, string_agg(e.spelt, '|' order by e.spelt) as variants
    from e join l on e.user_id = l.user_id and e.key = l.key group by e.user_id, e.key having sum(e.n) >= 2"""
)
def normalize_merge(spark, sf_dir):
    hits = rules.recurrence(occurrences(_mangled(spark, sf_dir), Matching(normalize=True)))
    return hits.select("record_id", "key", "item", F.col("count").alias("n"), F.array_join("variants", "|").alias("variants"))


@query(
    """with r as (select user_id, case when event_type in ('click', 'view') then 'visit' else event_type end as key, event_type from events),
    e as (select user_id, key, event_type, count(*) as n from r group by user_id, key, event_type)
    select cast(user_id as varchar) as record_id, key, cast(sum(n) as bigint) as n, string_agg(event_type, '|' order by event_type) as variants from e group by user_id, key having sum(n) >= 2"""
)
def synonym_merge(spark, sf_dir):
    occ = occurrences(sources.events(spark, sf_dir), Matching(synonyms={"click": "visit", "view": "visit"}))
    return rules.recurrence(occ).select("record_id", "key", F.col("count").alias("n"), F.array_join("variants", "|").alias("variants"))


@query(
    f"""with r as (select user_id, {_MANGLED} as spelt, event_type as key, cast(ts as date) as day, event_id from events),
    e as (select user_id, key, spelt, count(*) as n, min(cast(day as varchar) || lpad(cast(event_id as varchar), 20, '0')) as first from r group by user_id, key, spelt)
    select cast(user_id as varchar) as record_id, key, spelt as item from (select *, row_number() over (partition by user_id, key order by n desc, first) as k from e) where k = 1"""
)
def label_pick(spark, sf_dir):
    return named(occurrences(_mangled(spark, sf_dir), Matching(normalize=True))).select("record_id", "key", "item")


@query()
def fuzzy_merge(spark, sf_dir):
    """Event types with a letter missing in some events are merged again; difflib's ratio can't be expressed in SQL."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_id") % 3 == 0, F.expr("substr(event_type, 1, length(event_type) - 1)")).otherwise(F.col("event_type"))
    occ = occurrences(sources.rows(table.withColumn("event_type", kind), "user_id", "event_type", "ts", "event_id"), Matching(normalize=True, fuzzy_cutoff=0.85))
    return rules.recurrence(occ).select("record_id", "key", "item", F.col("count").alias("n"), _joined("variants"))


@query("select cast(user_id as varchar) as record_id, count(*) as n, count(distinct event_type) as items, min(cast(cast(ts as date) as varchar)) as first from events group by user_id")
def unnest_records(spark, sf_dir):
    """Events nested into records, with null and empty entries that must be left out, and unnested again."""
    entry = F.struct(F.col("date_str").alias("date"), F.col("original").alias("item"))
    bad = [F.struct(F.lit("2024-01-01").alias("date"), F.lit(x).cast("string").alias("item")) for x in (None, "")]
    nested = sources.events(spark, sf_dir).groupBy("record_seq").agg(F.min("record_id").alias("id"), F.concat(F.collect_list(entry), F.array(*bad)).alias("entries"))
    rows = unnested(sources.nested(nested.withColumnRenamed("record_seq", "seq"), "seq"))
    return rows.groupBy("record_id").agg(F.count("*").alias("n"), F.count_distinct("original").alias("items"), F.min("date_str").alias("first"))


# extraction


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.notes_of(sources.events(spark, sf_dir))


_TERMS = ["click", "view", "error", "signup", "purchase"]


@query("select cast(user_id as varchar) as record_id, cast(cast(ts as date) as varchar) as date, event_type as item, count(*) as n from events group by user_id, cast(ts as date), event_type")
def extract_roundtrip_events(spark, sf_dir):
    found = extract.records(_notes(spark, sf_dir), _TERMS)
    return found.select("id", F.inline("entries")).groupBy(F.col("id").alias("record_id"), "date", "item").agg(F.count("*").alias("n"))


@query("select user_id as note_id, cast(cast(ts as date) + 10 as varchar) as date, event_type as item, count(*) as n from events group by user_id, cast(ts as date), event_type")
def date_shift_entries(spark, sf_dir):
    found = extract.entries(_notes(spark, sf_dir), _TERMS, date_shift_days=10)
    return found.groupBy("note_id", "date", "item").agg(F.count("*").alias("n"))


@query(_gap_sql(_EVENTS, 7).replace("cast(last as varchar) as before_date, cast(day as varchar) as after_date", "cast(last + 400 as varchar) as before_date, cast(day + 400 as varchar) as after_date"))
def date_shift_invariance(spark, sf_dir):
    """Gaps of dates shifted alike are the same gaps."""
    found = extract.records(_notes(spark, sf_dir), _TERMS, date_shift_days=400)
    return _gap(occurrences(unnested(found)), 7)


@query(
    """with r as (select user_id, event_type, event_id, cast(cast(ts as date) - date '2024-01-01' as integer) as n from events)
    select user_id as note_id, event_type as item, case event_id % 4 when 0 then cast(date '2024-06-30' - n as varchar) when 1 then cast(date '2024-06-30' - 7 * n as varchar)
        when 2 then cast(cast(date '2024-06-30' - to_months(n) as date) as varchar) else '' end as date,
        case event_id % 4 when 3 then 'frequency' else 'relative' end as date_kind, count(*) as n from r group by all"""
)
def relative_dates(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.datediff(F.col("ts").cast("date"), F.lit(datetime.date(2024, 1, 1))).cast("string")
    phrase = F.when(F.col("event_id") % 4 == 0, F.concat(n, F.lit(" days ago: "))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("for the past "), n, F.lit(" Weeks, "))).when(F.col("event_id") % 4 == 2, F.concat(n, F.lit(" months prior "))).otherwise("q2wk ")
    notes = events.groupBy(F.col("user_id").alias("note_id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(phrase, F.col("event_type")))), "\n").alias("text"))
    found = extract.entries(notes, _TERMS, resolve_relative=True, reference_date=datetime.date(2024, 6, 30))
    return found.groupBy("note_id", "item", "date", "date_kind").agg(F.count("*").alias("n"))


_HEADED = "user_id % 7 <> 0"
_SHARED = "case when user_id % 11 = 0 then 'shared' else cast(user_id as varchar) end"


def _multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note for every ten users, a segment each; some without a header, some with a shared one, some with two."""
    rows = sources.events(spark, sf_dir)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date_str", "idx", "original"))), lambda x: F.concat_ws(" ", x["date_str"], x["original"])), "\n")
    users = rows.groupBy(F.col("record_seq").alias("user_id")).agg(lines.alias("lines"))
    header = F.when(F.col("user_id") % 7 == 0, "").otherwise(F.concat(F.lit("Patient: "), F.expr(_SHARED.replace("varchar", "string")), F.lit("\n")))
    second = F.when(F.col("user_id") % 13 == 1, "Patient: other\n").otherwise("")
    parts = users.select((F.col("user_id") / 10).cast("long").alias("note_id"), "user_id", F.concat(header, second, F.col("lines")).alias("part"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("user_id", "part"))), lambda x: x["part"])
    return parts.groupBy("note_id").agg(F.array_join(listed, "\n---\n").alias("text"))


@query(
    f"""with u as (select distinct user_id from events),
    s as (select cast(floor(user_id / 10) as bigint) as note_id, row_number() over (partition by floor(user_id / 10) order by user_id) - 1 as index, user_id,
        case when {_HEADED} then {_SHARED} when user_id % 13 = 1 then 'other' end as key, ({_HEADED}) and user_id % 13 = 1 as two from u),
    t as (select *, count(*) over (partition by note_id, case when key is not null and not two then key end) as same from s)
    select note_id, cast(index as bigint) as index, case when key is null then 'missing_key' when two then 'ambiguous_key' else 'duplicate_key' end as reason from t where key is null or two or same > 1"""
)
def multi_quarantine(spark, sf_dir):
    return extract.quarantined(_multi(spark, sf_dir), "\n---\n").select("note_id", F.col("index").cast("long").alias("index"), "reason")


@query(
    f"""with u as (select distinct user_id from events),
    s as (select cast(floor(user_id / 10) as bigint) as note_id, user_id,
        case when {_HEADED} then {_SHARED} when user_id % 13 = 1 then 'other' end as key, ({_HEADED}) and user_id % 13 = 1 as two from u),
    t as (select *, count(*) over (partition by note_id, case when key is not null and not two then key end) as same from s),
    a as (select note_id, user_id, key from t where key is not null and not two and same = 1)
    select a.note_id, 'p-' || a.key as id, cast(cast(e.ts as date) as varchar) as date, e.event_type as item, count(*) as n from a join events e on e.user_id = a.user_id group by all"""
)
def multi_accept(spark, sf_dir):
    found = extract.records_multi(_multi(spark, sf_dir), _TERMS, delimiter="\n---\n", record_id_prefix="p-")
    return found.select("note_id", "id", F.inline("entries")).groupBy("note_id", "id", "date", "item").agg(F.count("*").alias("n"))


#: Days by which the dates of users 1 to 150 are shifted; every third has none.
_SHIFTS = {str(user): user % 30 for user in range(1, 151) if user % 3}
_SEGMENTS = f"""with e as (select user_id, event_id, cast(ts as date) as day, event_type as item,
        sum(12 + length(event_type)) over (partition by user_id order by cast(ts as date), event_id) - length(event_type) - 1 as place from events),
    u as (select user_id, sum(12 + length(item)) - 1 as size from e group by user_id),
    s as (select cast(floor(user_id / 10) as bigint) as note_id, user_id, case when {_HEADED} then {_SHARED} when user_id % 13 = 1 then 'other' end as key, ({_HEADED}) and user_id % 13 = 1 as two,
        case when {_HEADED} then 10 + length({_SHARED}) else 0 end as head, size + case when {_HEADED} then 10 + length({_SHARED}) else 0 end + case when user_id % 13 = 1 then 15 else 0 end as size from u),
    t as (select *, count(*) over (partition by note_id, case when key is not null and not two then key end) as same, row_number() over w - 1 as index, sum(size + 5) over w - size - 5 as start,
        case when user_id between 1 and 150 and user_id % 3 <> 0 and key = cast(user_id as varchar) then user_id % 30 end as days from s window w as (partition by note_id order by user_id)),
    r as (select *, case when key is null then 'missing_key' when two then 'ambiguous_key' when same > 1 then 'duplicate_key' when days is null then 'missing_shift' end as reason from t)"""


@query(
    f"""{_SEGMENTS} select note_id, cast(index as bigint) as index, reason, cast(start as bigint) as char_offset,
        case reason when 'missing_key' then 'no Patient: header' when 'ambiguous_key' then '2 distinct headers' when 'duplicate_key' then 'key shared across segments' else 'no per-patient shift supplied' end as detail
    from r where reason is not null"""
)
def multi_refused(spark, sf_dir):
    """All four reasons to refuse a segment, with its place."""
    found = extract.quarantined(_multi(spark, sf_dir), "\n---\n", shift_by_id=_SHIFTS, require_shift=True)
    return found.select("note_id", F.col("index").cast("long").alias("index"), "reason", F.col("char_offset").cast("long").alias("char_offset"), "detail")


@query(
    f"""{_SEGMENTS} select r.note_id, 'p-' || key as id, cast(cast(day + cast(days as integer) as date) as varchar) as date, item, cast(start + head + place as integer) as first, cast(start + head + place + length(item) as integer) as last,
        cast(start as integer) as segment_start, cast(start + r.size as integer) as segment_end, cast(start + 9 as integer) as key_start
    from r join e on e.user_id = r.user_id where reason is null"""
)
def multi_shifted(spark, sf_dir):
    """Accepted segments with dates shifted by subject, and places in the whole note."""
    found = extract.records_multi(_multi(spark, sf_dir), _TERMS, delimiter="\n---\n", record_id_prefix="p-", shift_by_id=_SHIFTS, require_shift=True)
    at = F.col("provenance.segment_span")
    rows = found.select("note_id", "id", at[0].alias("segment_start"), at[1].alias("segment_end"), F.col("provenance.patient_key_span")[0].alias("key_start"), F.inline("entries"))
    return rows.select("note_id", "id", "date", "item", F.col("source_span")[0].alias("first"), F.col("source_span")[1].alias("last"), "segment_start", "segment_end", "key_start")


_WORDS = "regexp_split_to_array(lower(text), '[^0-9a-z]+')"


@query(
    f"""with w as (select doc_id, {_WORDS} as w from documents where text is not null)
    select doc_id, term, cast(len(list_filter(w, lambda x: x = term)) as bigint) as n from w, (values ('license'), ('token'), ('version')) t(term) where len(list_filter(w, lambda x: x = term)) > 0"""
)
def gazetteer_hits_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode_outer(extract.term_hits(F.col("text"), ["license", "token", "version"])).alias("hit")).where("hit is not null")
    return docs.groupBy("doc_id", F.col("hit.term").alias("term")).agg(F.count("*").alias("n"))


@query(
    """with l as (select doc_id, lower(text) as t from documents where text is not null),
    a as (select doc_id, (length(t) - length(replace(t, 'gnu general public license', ''))) // 26 as n1, replace(t, 'gnu general public license', '#') as t from l),
    b as (select doc_id, n1, (length(t) - length(replace(t, 'apache license', ''))) // 14 as n2, replace(t, 'apache license', '#') as t from a),
    c as (select doc_id, n1, n2, (length(t) - length(replace(t, 'license', ''))) // 7 - (length(t) - length(replace(t, 'licensed', ''))) // 8 as n3 from b)
    select doc_id, 'GNU General Public License' as term, cast(n1 as bigint) as n from c where n1 > 0 union all select doc_id, 'Apache License', cast(n2 as bigint) from c where n2 > 0
    union all select doc_id, 'license', cast(n3 as bigint) from c where n3 > 0"""
)
def gazetteer_longest_match(spark, sf_dir):
    terms = ["license", "Apache License", "GNU General Public License"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode_outer(extract.term_hits(F.col("text"), terms)).alias("hit")).where("hit is not null")
    return docs.groupBy("doc_id", F.col("hit.term").alias("term")).agg(F.count("*").alias("n"))


_PREFIX = "case event_id % 3 when 0 then '' when 1 then 'ß ' else 'İ x ﬁ ' end"
_STREET = "case event_id % 4 when 0 then 'Straße' when 1 then 'STRASSE' when 2 then 'strasse' else 'STRAẞE' end"


@query(
    f"""with n as (select event_id, cast(cast(ts as date) as varchar) as date, {_PREFIX} as p, {_STREET} as w from events)
    select event_id as note_id, date, 'Straße' as item, cast(11 + length(p) as integer) as first, cast(11 + length(p) + length(w) as integer) as last from n
    union all select event_id, date, 'fine', cast(12 + length(p) + length(w) as integer), cast(15 + length(p) + length(w) as integer) from n"""
)
def gazetteer_folded(spark, sf_dir):
    """Terms whose letters case folding lengthens, in four spellings, with their places in the original text."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.concat(F.col("ts").cast("date").cast("string"), F.lit(" "), F.expr(_PREFIX), F.expr(_STREET), F.lit(" ﬁne"))
    found = extract.entries(events.select(F.col("event_id").alias("note_id"), text.alias("text")), ["Straße", "fine"])
    return found.select("note_id", "date", "item", F.col("source_span")[0].alias("first"), F.col("source_span")[1].alias("last"))


_NOTE_LINES = """select user_id, event_id, cast(cast(ts as date) as varchar) as date, event_type as item,
    sum(12 + length(event_type)) over (partition by user_id order by cast(ts as date), event_id) - length(event_type) - 1 as place from events"""


@query(
    f"""select cast(user_id as varchar) as record_id, date, item, cast(11 + length(cast(user_id as varchar)) + place as integer) as first, cast(11 + length(cast(user_id as varchar)) + place + length(item) as integer) as last
    from ({_NOTE_LINES})"""
)
def entry_spans(spark, sf_dir):
    """Each entry with the place in its note that it cites."""
    found = extract.records(_notes(spark, sf_dir), _TERMS).select(F.col("id").alias("record_id"), F.inline("entries"))
    return found.select("record_id", "date", "item", F.col("source_span")[0].alias("first"), F.col("source_span")[1].alias("last"))


@query()
def gazetteer_fuzzy(spark, sf_dir):
    """Alike terms in notes; difflib's ratio can't be expressed in SQL."""
    matching = extract.TermMatching(mode="fuzzy", fuzzy_cutoff=0.8)
    return extract.entries(_notes(spark, sf_dir), ["clicks", "sign-up", "purchases"], matching=matching).groupBy("note_id", "item").agg(F.count("*").alias("n"))


@query(
    f"""select cast(user_id as varchar) as record_id, date || '  "' || item || '"  @[' || (11 + length(cast(user_id as varchar)) + place) || ', ' || (11 + length(cast(user_id as varchar)) + place + length(item)) || ']' as line
    from ({_NOTE_LINES})"""
)
def entry_lines(spark, sf_dir):
    found = extract.records(_notes(spark, sf_dir), _TERMS).select(F.col("id").alias("record_id"), F.inline("entries"))
    return found.select("record_id", extract.entry_line().alias("line"))


# scanner

_LINES = "select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as line from documents where text is not null"


#: Lines' card candidates: of each run of digit groups, groups from the leftmost on that make 13 to 19 digits, as many as
#: can be; then from the next group on.
_CARDS = """runs as (select doc_id, line, row_number() over () as run, g from (select doc_id, line, unnest(regexp_extract_all(t, '[0-9]+(?:[ -][0-9]+)*')) as g from l)),
    groups as (select run, unnest(regexp_extract_all(g, '[0-9]+')) as digits, generate_subscripts(regexp_extract_all(g, '[0-9]+'), 1) as i from runs where length(regexp_replace(g, '[^0-9]', '', 'g')) >= 13),
    ends as (select run, i, digits, sum(length(digits)) over (partition by run order by i) as upto from groups),
    wide as (select a.run, a.i, max(b.i) as j from ends a join ends b on a.run = b.run and b.i between a.i and a.i + 18 and b.upto - a.upto + length(a.digits) between 13 and 19 group by a.run, a.i),
    taken(run, i, j) as (select run, min(i), arg_min(j, i) from wide group by run
        union all select x.run, min(w.i), arg_min(w.j, w.i) from taken x join wide w on w.run = x.run and w.i > x.j group by x.run, x.j),
    numbers as (select t.run, t.i, string_agg(e.digits, '' order by e.i) as d from taken t join ends e on e.run = t.run and e.i between t.i and t.j group by t.run, t.i),
    sums as (select run, list_sum(list_transform(generate_series(1, length(d)), lambda k: (cast(substr(d, cast(length(d) - k + 1 as integer), 1) as integer) * (2 - k % 2)) // 10 + (cast(substr(d, cast(length(d) - k + 1 as integer), 1) as integer) * (2 - k % 2)) % 10)) as total from numbers),
    cards as (select distinct doc_id, line from sums join runs on runs.run = sums.run where total % 10 = 0)"""


@query(
    f"""with recursive l as ({_LINES}), {_CARDS},
    f as (select doc_id, line, 'secret' as detector_id from l where regexp_matches(t, '\\bgh[pousr]_[A-Za-z0-9]{{20,}}\\b') or regexp_matches(t, '\\bgithub_pat_[A-Za-z0-9_]{{20,}}\\b') or regexp_matches(t, '\\bAKIA[0-9A-Z]{{16}}\\b')
        or regexp_matches(t, '\\bsk-(?:proj-)?[A-Za-z0-9_-]{{20,}}\\b') or regexp_matches(t, '(?i)\\b(?:api[_-]?key|client[_-]?secret|password|passwd|secret|token)\\b\\s*[:=]\\s*[''"]?[A-Za-z0-9_./+=-]{{12,}}')
    union all select doc_id, line, 'private-key' from l where regexp_matches(t, '-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----')
    union all select doc_id, line, 'email' from l where regexp_matches(t, '[\\p{{L}}\\p{{M}}\\p{{N}}_.+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')
    union all select doc_id, line, 'ssn' from l where regexp_matches(t, '(^|[^0-9])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}($|[^0-9])')
    union all select doc_id, line, 'phone' from l where regexp_matches(t, '(^|[^0-9])(?:\\+?1[-. ]?)?\\(?[2-9][0-9]{{2}}\\)?[-. ][0-9]{{3}}[-. ][0-9]{{4}}($|[^0-9])')
    union all select doc_id, line, 'mrn' from l where regexp_matches(t, '(?i)\\b(?:mrn|medical record(?: number)?)\\s*[:=#-]?\\s*[A-Z0-9][A-Z0-9-]{{3,}}\\b')
    union all select doc_id, line, 'dob' from l where regexp_matches(t, '(?i)\\b(?:dob|date of birth)\\s*[:=#-]?\\s*(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}})\\b')
    union all select doc_id, line, 'payment-card' from cards)
    select detector_id, 'documents/' || doc_id as path, cast(line as bigint) as line from f"""
)
def scan_documents(spark, sf_dir):
    """All detectors on all lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sensitive.scan_lines(sensitive.document_lines(docs)).select("detector_id", "path", "line")


@query(f"with recursive l as ({_LINES}), {_CARDS} select 'documents/' || doc_id as path, cast(line as bigint) as line from cards")
def scan_luhn(spark, sf_dir):
    """Lines with a card number."""
    rows = sensitive.document_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return sensitive.scan_lines(rows).where("detector_id = 'payment-card'").select("path", "line")


@query()
def scan_diffs(spark, sf_dir):
    """Documents as unified diffs that add their lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    text = F.concat(F.lit("+++ b/docs/"), F.col("doc_id").cast("string"), F.lit(".txt\n@@ -0,0 +1,9 @@\n+"), F.replace("text", F.lit("\n"), F.lit("\n+")))
    return sensitive.scan_diffs(docs.select(F.col("doc_id").alias("diff_id"), text.alias("text"))).groupBy("detector_id").agg(F.count("*").alias("n"))


#: Paths that protect themselves, one for each pattern, and some that don't; %d stands for the document's number.
_PATHS = {"a/%d.pem": True, ".env.%d": True, "x/.ENV": True, "k/id_rsa.%d": True, "conf%d/Secrets.yaml": True, "real_patient/%d": True, "phi": True, "secrets/%d.txt": False, "env/%d": False, "a/%d.pem.txt": False, "phial/%d": False}


@query(f"select distinct path, cast(0 as bigint) as line from ({' union all '.join(f"select replace('{path}', '%d', cast(doc_id as varchar)) as path from documents" for path, there in _PATHS.items() if there)})")
def scan_paths(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    paths = F.array(*(F.replace(F.lit(p), F.lit("%d"), F.col("doc_id").cast("string")) for p in _PATHS))
    return sensitive.scan_paths(docs.select(F.explode(paths).alias("path"))).select("path", "line")


# audit


def _core() -> Column:
    """An event as canonical text."""
    return F.format_string('{"agent":"a","entity":{},"payload":{"id":%d},"recorded":"","seq":%d,"type":"%s"}', "event_id", "pos", "event_type")


def _trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trail for each user: (user_id, pos, core, seq, prev_hash, entry_hash)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.withColumn("pos", F.row_number().over(Over.partitionBy("user_id").orderBy("event_id"))).withColumn("core", _core())
    cores = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("pos", "core"))).alias("all"))
    step = lambda h, e: F.concat(h, F.array(F.sha2(F.concat(F.element_at(h, -1), F.lit("\n"), e["core"]), 256)))
    chained = cores.withColumn("hashes", F.aggregate("all", F.array(F.lit(audit.GENESIS)), step))
    return chained.select("user_id", "hashes", F.inline("all")).select("user_id", "pos", "core", F.col("pos").cast("long").alias("seq"), F.element_at("hashes", F.col("pos")).alias("prev_hash"), F.element_at("hashes", F.col("pos") + 1).alias("entry_hash"))


@query(
    """with r as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as pos from events),
    t as (select user_id, list('{"agent":"a","entity":{},"payload":{"id":' || event_id || '},"recorded":"","seq":' || pos || ',"type":"' || event_type || '"}' order by pos) as l from r group by user_id)
    select user_id, list_reduce(list_prepend(repeat('0', 64), l), lambda a, b: sha256(a || chr(10) || b)) as head from t"""
)
def audit_chain_head(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.withColumn("pos", F.row_number().over(Over.partitionBy("user_id").orderBy("event_id"))).withColumn("core", _core())
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "core"))), lambda x: x["core"])
    return rows.groupBy("user_id").agg(texts.alias("texts")).select("user_id", audit.chain_head(F.col("texts")).alias("head"))


@query(
    """select user_id, min(case when event_id % 97 = 0 then pos end) is null as ok, cast(min(case when event_id % 97 = 0 then pos end) as bigint) as first_bad_seq
    from (select user_id, event_id, row_number() over (partition by user_id order by event_id) as pos from events) group by user_id"""
)
def audit_verify(spark, sf_dir):
    """Trails in which some events were edited after the fact."""
    edited = F.when(F.get_json_object("core", "$.payload.id").cast("long") % 97 == 0, F.replace("core", F.lit('"agent":"a"'), F.lit('"agent":"b"'))).otherwise(F.col("core"))
    found = audit.first_bad(_trails(spark, sf_dir).withColumn("core", edited), ["user_id"])
    return found.select("user_id", "ok", F.col("first_bad_seq").cast("long").alias("first_bad_seq"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trail of one event for each event: reports with findings, extractions with quarantined segments."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id is not null")
    found = F.format_string('{"findings":{"%s":%d}}', "event_type", (F.col("event_id") % 5).cast("int"))
    refused = F.format_string('{"quarantined":{"missing_key":%d}}', (F.col("event_id") % 3).cast("int"))
    is_report = F.col("event_id") % 2 == 0
    return events.select((F.col("event_id") + 1).alias("pos"), F.when(is_report, "report").otherwise("extract_multi").alias("type"), F.when(is_report, found).otherwise(refused).alias("payload"))


@query(
    """select 'events' as kind, case when event_id % 2 = 0 then 'report' else 'extract_multi' end as name, count(*) as n from events group by all union all
    select 'findings', event_type, cast(sum(event_id % 5) as bigint) from events where event_id % 2 = 0 group by all union all
    select 'quarantined', 'missing_key', cast(sum(event_id % 3) as bigint) from events where event_id % 2 = 1 group by all"""
)
def audit_summary(spark, sf_dir):
    return audit.summary(_reports(spark, sf_dir))


@query(
    """with s as (select event_type as lens, cast(coalesce(sum(case when event_id + 1 <= 500 then event_id % 5 end), 0) as bigint) as before, cast(coalesce(sum(case when event_id + 1 > 500 then event_id % 5 end), 0) as bigint) as after from events where event_id % 2 = 0 group by event_type)
    select lens, before, after, after - before as difference from s"""
)
def audit_compare(spark, sf_dir):
    return audit.compared(_reports(spark, sf_dir), 500)


# views


@query(
    """with b as (select user_id, min(cast(ts as date)) as first, max(cast(ts as date)) as last from events group by user_id having min(cast(ts as date)) < max(cast(ts as date))),
    h as (select user_id, event_type, cast(ts as date) as day from events where (user_id, event_type) in (select user_id, event_type from events group by user_id, event_type having count(*) >= 2) group by all)
    select cast(h.user_id as varchar) as record_id, event_type as item, cast(day as varchar) as date, cast(floor((day - first) * 10000 / (last - first)) as bigint) as place from h join b on h.user_id = b.user_id"""
)
def timeline_ticks(spark, sf_dir):
    occ = _events(spark, sf_dir)
    rows = views.ticks(rules.recurrence(occ), views.axis(occ))
    return rows.select("record_id", "item", "date", F.floor(F.round(F.col("percent") * 100, 6)).cast("long").alias("place"))


_CHIPS = "string_agg('<span class=\"chip\">' || cast(day as varchar) || '</span>', '' order by day)"


@query(
    f"""select cast(seq as varchar) as record_id, item, cast(count(*) as integer) as chips, count(*) > 3 as folded,
        '<article class="card"><h3>' || item || '</h3><p>&quot;' || item || '&quot; recurred ' || count(*) || ' times — ' || string_agg(cast(day as varchar), ', ' order by day) || '</p>'
        || case when count(*) > 3 then '<details><summary>' || count(*) || ' dates</summary>' || {_CHIPS} || '</details>' else {_CHIPS} end || '</article>' as card
    from ({_EVENTS}) group by seq, item having count(*) >= 2"""
)
def report_cards(spark, sf_dir):
    hits = rules.recurrence(_events(spark, sf_dir)).withColumn("lens", F.lit("recurrence")).withColumn("line", report.recurrence_line())
    return views.cards(hits).select("record_id", "item", "chips", "folded", "card")


@query(
    """select user_id as note_id, 'Patient: ' || user_id || chr(10) || chr(10) || string_agg(cast(cast(ts as date) as varchar) || ' <mark class="item">' || event_type || '</mark>', chr(10) order by cast(ts as date), event_id) || chr(10) as html
    from events group by user_id"""
)
def marked_notes(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    return views.marked(notes, views.spans(extract.entries(notes, _TERMS), ["note_id"])).select("note_id", "html")
