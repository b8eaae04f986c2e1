"""SQL for the queries that SQL can express."""

from __future__ import annotations

import string

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase

#: Shingle sets, all pairs that share a shingle, links, and what links reach.
JACCARD = f"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from w),
n as (select doc_id, len(s) as n from s),
t as (select doc_id, unnest(s) as t from s),
c as (select a.doc_id as x, b.doc_id as y, count(*) as c from t a join t b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 90 * (p.n + q.n - c)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id, doc_id as root from documents union select e.y, r.root from r join e on e.x = r.doc_id)
select doc_id, n as n_shingles, (select min(root) from r where r.doc_id = n.doc_id) as component_id from n
""".replace("(select min(root) from r where r.doc_id = n.doc_id) as component_id from n", "component_id from n join (select doc_id, min(root) as component_id from r group by 1) using (doc_id)")
