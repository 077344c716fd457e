"""DuckDB SQL for the corpus queries that SQL can express: each states its contract anew and shares only fixed values."""

from __future__ import annotations

import math

from tracewright.llm.licenses import TEMPLATES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def near_duplicates(words: int = 4) -> str:
    """All pairs that share a shingle, and everything reachable over their links. For small tables."""
    return rf"""with recursive w as (select doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
    g as (select doc_id, w, unnest(generate_series(1, greatest(len(w) - {words - 1}, 1))) as i from w where len(w) > 0),
    s as (select distinct doc_id, array_to_string(w[i:i + {words - 1}], ' ') as sh from g),
    n as (select doc_id, count(*) as n from s group by doc_id),
    p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
    l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
    e as (select a as u, b as v from l union select b, a from l),
    r as (select doc_id, doc_id as root from documents union select r.doc_id, e.v from r join e on r.root = e.u)
select d.doc_id, cast(coalesce(any_value(n.n), 0) as bigint) as n_shingles, min(r.root) as component_id, d.doc_id = min(r.root) as kept
from documents d join r on r.doc_id = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id"""


def licenses(threshold: float = 0.9) -> str:
    """Every block against every template."""
    sets = {name: sorted(set(text.split())) for name, text in TEMPLATES.items()}
    rows = ", ".join(f"('{name}', {own!r}, {math.ceil(threshold * len(own) - 1e-9)}, {len(TEMPLATES[name].split())})" for name, own in sets.items())
    block = "list_intersect(list_distinct(w[k0 + 1:k0 + 2 * step]), own)"
    return rf"""with w as (select doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
    p as (select doc_id, w,
        list_filter(generate_series(1, len(w)), lambda i: w[i] = 'gnu' and w[i + 1] = 'general' and w[i + 2] = 'public' and w[i + 3] = 'license') as gpl,
        list_filter(generate_series(1, len(w)), lambda i: w[i] = 'apache' and w[i + 1] = 'license') as apache,
        list_filter(generate_series(1, len(w)), lambda i: w[i] = 'cc' and w[i + 1] = 'by') as cc,
        list_filter(generate_series(1, len(w)), lambda i: w[i] = 'mit' and w[i + 1] = 'license') as mit from w),
    t(name, own, needed, step) as (values {rows}),
    b as (select doc_id, w, name, own, needed, step, unnest(generate_series(0, greatest(len(w) - 1, 0), step)) as k0 from w, t),
    m as (select doc_id, name, max(len({block}) / len(own)) as share from b where (k0 = 0 or len(w) > k0 + step) and len({block}) >= needed group by doc_id, name),
    l as (select doc_id, list(name) as names, max(share) as share from m group by doc_id),
    a as (select doc_id, len(w) as n_words, list_concat(list_concat(gpl, apache), list_concat(cc, mit)) as places,
        list_filter([case when len(apache) > 0 then 'apache' end, case when len(cc) > 0 then 'cc-by' end, case when len(gpl) > 0 then 'gpl' end, case when len(mit) > 0 then 'mit' end], lambda x: x is not null) as labels from p)
select a.doc_id, cast(n_words as bigint) as n_words, cast(len(places) as bigint) as n_base, cast(list_min(places) - 1 as bigint) as first_word, cast(list_max(places) - 1 as bigint) as last_word,
    array_to_string(labels, ',') as base_labels, array_to_string(list_sort(list_distinct(list_concat(labels, coalesce(names, [])))), ',') as labels,
    cast(case when len(places) > 0 then 1 else coalesce(share, 0) end as double) as score
from a left join l on l.doc_id = a.doc_id"""
