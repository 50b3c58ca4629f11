"""SQL of the training-data queries that SQL can express, over the same tables."""

from __future__ import annotations

from . import quality_rules as q

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_share = lambda a, b: f"case when {b} > 0 then 100 * {a} // {b} else 0 end"
_grid = ", ".join(f"({c})" for c in q.GRID)
_rules = " union all ".join(f"select doc_id, stratum, '{r}' as rule, {v} as v from f" for r, v in zip(q.RULES, (_share("n_symbols", "word_chars"), _share("n_dup_lines", "n_lines"), _share("n_repeat_words", "n_words"), _share("n_capitals", "word_chars")), strict=True))
_p = q.RISK / len(q.RULES)

OP1 = f"""with d as (select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as l from documents),
g as (select doc_id, i, w[i:i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from (select doc_id, i, count(*) over (partition by doc_id, g) as k from g) where k > 1) group by doc_id),
f as (select d.doc_id, stratum, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(l) as bigint) as n_lines, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
  cast(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as bigint) as n_capitals, cast(coalesce(n, 0) as bigint) as n_repeat_words from d left join rep using (doc_id)),
v as ({_rules}),
held as (select v.* from v join f using (doc_id) join (select doc_id from labels where quality = 1) using (doc_id) where not (n_words < 50 or 100 * n_repeat_words > 50 * n_words)),
tests as (select v.stratum, rule, cutoff, count(*) as n, count(*) filter (v > cutoff) as k from held v, (values {_grid}) c(cutoff) group by all),
tails as (select *, case when k >= n * {_p} then 1.0 else list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_p}) + (n - i) * ln(1 - {_p})))) end as p from tests),
holm as (select *, cast(p > {q.DELTA} / (count(*) over () - row_number() over (order by p, stratum, rule, cutoff) + 1) as int) as bad from tails),
passed as (select * from (select *, max(bad) over (order by p, stratum, rule, cutoff rows unbounded preceding) as stop from holm) where stop = 0),
cuts as (select stratum, rule, min(cutoff) as cutoff from passed group by stratum, rule),
failed as (select distinct doc_id from v join cuts using (stratum, rule) where v > cutoff)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and doc_id not in (select doc_id from failed) as kept
from (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f)"""

OP2 = f"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
s as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d)),
later as (select doc_id, i from s qualify row_number() over (partition by s order by doc_id, i) > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from later),
words as (select doc_id, p, w[p] as word from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d)),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by p) as kept from words where (doc_id, p) not in (select (doc_id, p) from gone) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join kept using (doc_id)"""

OP4 = f"""with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '{_WORD}') as w from documents),
s as (select distinct doc_id, g from (select doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d)),
n as (select doc_id, count(*) as n from s group by doc_id),
l as (select a.doc_id as a, b.doc_id as b from s a join s b on a.g = b.g and a.doc_id <> b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 90 * (x.n + y.n - count(*))),
r(a, b) as (select doc_id, doc_id from d union select r.a, l.b from r join l on l.a = r.b)
select doc_id, coalesce(n.n, 0) as n_shingles, component_id from d left join n using (doc_id) join (select a as doc_id, min(b) as component_id from r group by a) using (doc_id)"""

OP11 = rf"""with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) as piece from documents where text is not null),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
n as (select lang, sum(len(w)) as n from w group by lang),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from w, (select unnest([1, 2, 3, 4, 5]) as k) where len(w) >= k),
f as (select lang, k, phrase, count(*) as f from g group by lang, k, phrase having count(*) >= 100),
inside as (select lang, phrase, max(f) as longer from (select lang, f, unnest(list_distinct([array_to_string(string_split(phrase, ' ')[1:k - 1], ' '), array_to_string(string_split(phrase, ' ')[2:k], ' ')])) as phrase from f where k > 2) group by lang, phrase),
good as (select f.* from f left join inside using (lang, phrase) where f.k > 1 and (longer is null or 100 * longer < 100 * f.f)),
cuts as (select lang, phrase, f as a, cut, array_to_string(string_split(phrase, ' ')[1:cut], ' ') as left_, array_to_string(string_split(phrase, ' ')[cut + 1:k], ' ') as right_ from good, (select unnest([1, 2, 3, 4]) as cut) where cut < k),
scored as (select cuts.*, x.f as l, y.f as r, n.n, cast((cast(1000 as hugeint) * a * n.n) // (cast(x.f as hugeint) * y.f) as bigint) as score from cuts join f x on x.lang = cuts.lang and x.phrase = left_ join f y on y.lang = cuts.lang and y.phrase = right_ join n on n.lang = cuts.lang),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, cast(n as bigint) as n, score from best qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000"""

OP12 = """with recursive turns as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as pos from conversations where conv_id is not null),
ids as (select distinct c from turns),
tab(i, k, v) as (select i, 0, i from range(256) r(i) union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from tab where k < 8),
crc(c, p, v) as (select c, 1, 4294967295 from ids union all select c, p + 1, xor(crc.v >> 8, tab.v) from crc join tab on tab.k = 8 and tab.i = xor(crc.v & 255, ascii(substr(cast(c as varchar), p, 1))) where p <= length(cast(c as varchar))),
h as (select c, xor(v, 4294967295) % 6 as h from crc where p = length(cast(c as varchar)) + 1),
built as (select h.c, 0 as part, pos, role, text from h join turns on turns.c = h.c - h.c % 100 and pos < h union all select h.c, 1, pos, role, text from h join turns on turns.c = h.c and pos >= h),
placed as (select *, row_number() over (partition by c order by part, pos) as depth from built),
keyed as (select *, md5(string_agg(md5(length(role) || ':' || role || text), '' order by depth) over (partition by c order by depth)) as key from placed),
paths as (select c, depth, key, length(text) as size, lag(key, 1, '') over (partition by c order by depth) as parent from keyed union all select c, 0, '', 0, null from ids),
last as (select c, max(depth) as depth from paths group by c),
nodes as (select key, any_value(depth) as depth, any_value(parent) as parent, any_value(size) as size, min(c) as c, count(*) as n from paths group by key),
children as (select parent as key, count(*) as n_children from nodes group by parent),
below as (select a.key, sum((v.n - 1) * v.size) as saved, count(*) filter (n_children is null) as leaves from nodes v left join children on children.key = v.key join paths a on a.c = v.c and a.depth <= v.depth group by a.key),
ends as (select key, string_agg(cast(c as varchar), ',' order by c) as ends from paths join last using (c, depth) group by key)
select nodes.c as conv_id, cast(nodes.depth as bigint) as depth, up.c as parent_conv_id, nodes.n as n_convs, coalesce(n_children, 0) as n_children, leaves as n_leaves, cast(saved as bigint) as saved_tokens, sha256(coalesce(ends, '')) as ends_sha256
from nodes left join nodes up on up.key = nodes.parent left join children on children.key = nodes.key join below on below.key = nodes.key left join ends on ends.key = nodes.key"""

OP13 = f"""with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '{_WORD}') as w from documents),
s as (select distinct doc_id, g from (select doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d)),
n as (select doc_id, count(*) as n from s group by doc_id),
l as (select a.doc_id as a, b.doc_id as b from s a join s b on a.g = b.g and a.doc_id <> b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r(a, b) as (select doc_id, doc_id from d union select r.a, l.b from r join l on l.a = r.b),
c as (select a as doc_id, min(b) as component_id from r group by a)
select doc_id, coalesce(n.n, 0) as n_shingles, component_id, doc_id = component_id as kept from d left join n using (doc_id) join c using (doc_id)"""

OP8 = rf"""with words as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, len(w[i:i + 9]) as k, array_to_string(w[i:i + 9], ' ') as s from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from items where len(w) > 0)),
dw as (select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') as s from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from words, (select distinct k from bw))),
hits as (select doc_id, i, dw.k, item_id from dw join bw on dw.k = bw.k and dw.s = bw.s),
n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hits) group by doc_id),
m as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select doc_id, cast(coalesce(len(w), 0) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from words left join n using (doc_id) left join m using (doc_id)"""

#: Words ordered by exact counts: any order gives the same pairs.
OP9 = f"""with l as (select doc_id, i, list_distinct(regexp_extract_all(x[i], '{_WORD}')) as w from (select doc_id, x, unnest(range(1, len(x) + 1)) as i from (select doc_id, string_split(text, chr(10)) as x from documents where text is not null))),
e as (select doc_id, i, w, len(w) as n from l where len(w) > 0),
t as (select doc_id, i, n, unnest(w) as word from e),
f as (select word, count(*) as c from t group by word),
o as (select doc_id, i, n, word, row_number() over (partition by doc_id, i order by c, word) as nth from t join f using (word)),
p as (select * from o where nth <= n - (80 * n + 99) // 100 + 1),
c as (select distinct a.doc_id, a.i, b.doc_id as d2, b.i as i2 from p a join p b on a.word = b.word and (a.doc_id, a.i) > (b.doc_id, b.i) and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
gone as (select distinct c.doc_id, c.i from c join e x on x.doc_id = c.doc_id and x.i = c.i join e y on y.doc_id = c.d2 and y.i = c.i2 where 100 * len(list_intersect(x.w, y.w)) >= 80 * (x.n + y.n - len(list_intersect(x.w, y.w)))),
g as (select doc_id, count(*) as n, string_agg(cast(i - 1 as varchar), ',' order by i) as removed from gone group by doc_id)
select doc_id, cast(coalesce(len(string_split(text, chr(10))), 0) as bigint) as n_lines, coalesce(n, 0) as n_removed, coalesce(removed, '') as removed from documents left join g using (doc_id)"""

SQL = {"op1_quality_rules": OP1, "op2_substring_dedup": OP2, "op4_ngram_join": OP4, "op8_decontaminate": OP8, "op9_line_dedup": OP9, "op11_phrases": OP11, "op12_conversation_trie": OP12, "op13_minhash_dedup": OP13}
