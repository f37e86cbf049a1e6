"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

TOP_K = """
with v as (select vec_id, embedding::double[] e from embeddings where vec_id is not null and embedding is not null),
r as (select vec_id, list_transform(e, lambda x: floor(256 * x)) x from v where len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0),
a as (select distinct vec_id, x from r where vec_id % 50 = 0),
s as (select q.vec_id query_id, q.x x, c.vec_id vec_id, list_inner_product(q.x, c.x)::bigint score from a q join r c on q.vec_id != c.vec_id),
k as (select *, row_number() over (partition by query_id, x order by score desc, vec_id) rank from s)
select query_id, rank::int as rank, vec_id, score from k where rank <= 5"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CONTAMINATION = rf"""
with d as (select row_number() over () r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
i as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where item_id is not null),
j as (select item_id, w, least(len(w), 10) n from i where len(w) > 0),
win as (select distinct item_id, n, array_to_string(w[s + 1:s + n], ' ') t from (select *, unnest(generate_series(0, len(w) - n)) s from j)),
tries as (select r, n, s, array_to_string(w[s + 1:s + n], ' ') t from (select r, w, n, unnest(generate_series(0, len(w) - n)) s from d, (select distinct n from win) where len(w) >= n)),
hit as (select r, n, s, item_id from tries join win using (n, t)),
words as (select r, count(distinct s + o) n_hit from (select distinct r, n, s from hit) h, lateral (select unnest(generate_series(0, h.n - 1)) o) group by 1),
items as (select r, count(*) n_items, string_agg(x, ',' order by x) ids from (select distinct r, item_id::varchar x from hit) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256,
coalesce(n_hit, 0) > 0 as contaminated from d left join words using (r) left join items using (r)"""

NEAR_DUPLICATES = rf"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x != '') w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) end s from w),
c as (select s, min(doc_id) rep, row_number() over (order by min(doc_id)) k from s where len(s) > 0 group by s),
e as (select k, len(s) n, unnest(s) x from c),
l as (select a.k ka, b.k kb from e a join e b on a.x = b.x and a.k < b.k group by a.k, b.k, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
g as (select ka a, kb b from l union select kb, ka from l),
reach(k, to_) as (select k, k from c union select reach.k, g.b from reach join g on g.a = reach.to_),
m as (select reach.k, min(rep) component from reach join c on c.k = reach.to_ group by 1)
select s.doc_id, len(s.s)::bigint n_shingles, coalesce(m.component, s.doc_id) component_id, s.doc_id = coalesce(m.component, s.doc_id) as kept
from s left join c on c.s = s.s left join m using (k)"""

FILTER_AUDIT = r"""
with d as (select doc_id, coalesce(source, '') part, coalesce(text, '') t from documents),
l as (select doc_id, coalesce(bool_or(quality = 1), false) good, coalesce(bool_or(toxic = 1), false) toxic from labels group by doc_id),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x != '') ws, min(doc_id) over (partition by t) lo from d),
m as (select part, coalesce(good, false) good, coalesce(toxic, false) toxic,
  [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > lo, false)] f
  from w left join l using (doc_id)),
c as (select part, f, good, toxic, count(*) n from m group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
o as (select a.x || b.x || c.x || d.x || e.x filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, step, filter_order[step] letter, list_transform(string_split(filter_order[:step - 1], ''), lambda y: instr('ABCDE', y)) before, instr('ABCDE', filter_order[step]) this from o, (select unnest([1, 2, 3, 4, 5])::int step)),
r as (select part, filter_order, step, letter, f[this] fails, step > 1 and len(list_filter(before, lambda y: y > 0 and f[y])) > 0 gone, len(list_filter(f, lambda y: y)) = 1 alone, n, good, toxic from c, s),
g as (select part, filter_order, step, letter, coalesce(sum(n) filter (not gone and not fails), 0)::bigint kept, coalesce(sum(n) filter (fails and not gone), 0)::bigint removed,
  coalesce(sum(n) filter (fails and gone), 0)::bigint redundant, coalesce(sum(n) filter (fails and alone), 0)::bigint unique_fails,
  coalesce(sum(n) filter (fails and not gone and good), 0)::bigint good_lost, coalesce(sum(n) filter (fails and not gone and toxic), 0)::bigint toxic_lost from r group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, letter))::bigint shapley from g"""

URL_RULES = r"""
with r as (select * from (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(h, p, v)),
u as (select row_number() over () k, page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') path from pages),
f as (select k, arg_max(h || p, len(h || p) * 10000 + len(h)) rule, arg_max(v, len(h || p) * 10000 + len(h)) v from u join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by k)
select page_id, host, path, rule, coalesce(v, 'allow') verdict from u left join f using (k)"""

ORACLES: dict[str, str] = {"op3_topk": TOP_K, "op4_decontamination": CONTAMINATION, "op10_near_dedup": NEAR_DUPLICATES, "op12_filter_audit": FILTER_AUDIT, "op13_url_rules": URL_RULES}
