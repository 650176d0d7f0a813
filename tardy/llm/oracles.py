"""DuckDB SQL that states results from their definitions."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def near_duplicates_sql(percent: int = 85, k: int = 5) -> str:
    """All pairs of documents that share a shingle, then components by recursion."""
    return rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < {k} then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) end as s from w),
n as (select doc_id, len(s) as n from s),
x as (select doc_id, unnest(s) as s from s),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from x a join x b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from common join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= {percent} * (p.n + q.n - c)),
edge as (select a, b from link union all select b, a from link),
reach(doc_id, r) as (select doc_id, doc_id from n union select e.b, reach.r from reach join edge e on e.a = reach.doc_id where reach.r < e.b)
select n.doc_id, cast(n.n as bigint) as n_shingles, c.component_id, n.doc_id = c.component_id as kept
from n join (select doc_id, min(r) as component_id from reach group by 1) c using (doc_id)"""


def contamination_sql(window: int = 10) -> str:
    """Every window of every document compared with the items' windows."""
    words = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
with d as (select row_number() over () as rn, doc_id, {words} as w from documents),
b as (select item_id, w, least(len(w), {window}) as l from (select item_id, {words} as w from benchmark) where len(w) > 0),
iw as (select distinct cast(item_id as varchar) as item, l, array_to_string(w[i:i + l - 1], ' ') as k from (select *, unnest(range(1, len(w) - l + 2)) as i from b)),
dw as (select rn, i, l, array_to_string(w[i:i + l - 1], ' ') as k from (select rn, w, l, unnest(range(1, len(w) - l + 2)) as i from d, (select distinct l from iw) where len(w) >= l)),
occ as (select rn, i, dw.l, item from dw join iw using (l, k)),
hits as (select rn, count(distinct p) as n from (select rn, unnest(range(i, i + l)) as p from occ) group by rn),
items as (select rn, count(*) as n, string_agg(item, ',' order by item) as names from (select distinct rn, item from occ where item is not null) group by rn)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(hits.n, 0) as bigint) as n_hit, cast(coalesce(items.n, 0) as bigint) as n_items,
  sha256(coalesce(items.names, '')) as items_sha256, coalesce(hits.n, 0) > 0 as contaminated
from d left join hits using (rn) left join items using (rn)"""
