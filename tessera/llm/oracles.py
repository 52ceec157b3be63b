"""DuckDB SQL for the operators that it can express, written independently of them."""

from __future__ import annotations

from .license_scan import NOTICES, PHRASES, THRESHOLD
from .tool_calls import OP10_SQL

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_PHRASES = ", ".join(f"('{p}', {len(p.split())}, '{label}')" for p, label in PHRASES.items())
_NOTICES = ", ".join(f"('{n}', '{label}')" for n, label in NOTICES.items())

OP1_SQL = rf"""
with d as (select doc_id, regexp_extract_all({_LOW}, {_PLAIN}) as w from documents),
p as (select string_split(p, ' ') as p, n, label from (values {_PHRASES}) v(p, n, label)),
b as (select doc_id, label, unnest(list_filter(range(len(w) - n + 1), lambda k: w[k + 1:k + n] = p)) as place from d, p where list_contains(w, p[1])),
base as (select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word, array_to_string(list_sort(list(distinct label)), ',') as base_labels, list(distinct label) as ls from b group by 1),
n as (select n, label, len(list_distinct(string_split(n, ' '))) as m, cast(floor(len(string_split(n, ' ')) / {THRESHOLD} + 1e-9) as bigint) as reach from (values {_NOTICES}) v(n, label)),
s as (select distinct n, label, m, reach, unnest(string_split(n, ' ')) as word from n),
u as (select doc_id, word, pos from (select doc_id, unnest(w) as word, unnest(range(len(w))) as pos from d) where word in (select word from s)),
h as (select s.*, doc_id, pos from u join s using (word)),
k as (select * from h where (doc_id, n) in (select (doc_id, n) from h group by doc_id, n, m having count(distinct word) >= {THRESHOLD} * m - 1e-9)),
c as (select a.doc_id, a.label, cast(count(distinct z.word) as double) / a.m as share from k a join k z on a.doc_id = z.doc_id and a.n = z.n and z.pos >= a.pos and z.pos < a.pos + a.reach group by a.doc_id, a.n, a.label, a.m, a.pos having count(distinct z.word) >= {THRESHOLD} * a.m - 1e-9),
notice as (select doc_id, list(distinct label) as ls, max(share) as share from c group by 1)
select doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(notice.ls, [])))), ',') as labels, case when n_base > 0 then 1.0::double else coalesce(share, 0::double) end as score
from d left join base using (doc_id) left join notice using (doc_id)
"""

OP4_SQL = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93),
r as (select vec_id, vec_id as root from v union select p.b, r.root from r join p on p.a = r.vec_id),
n as (select a as vec_id, count(*) as n_links from p group by 1)
select vec_id, coalesce(max(n_links), 0) as n_links, min(root) as component_id, vec_id = min(root) as kept from r left join n using (vec_id) group by vec_id
"""

OP5_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
u as (select doc_id, unnest(w) as word, unnest(range(len(w))) as pos, len(w) as n from d),
h as (select *, md5(string_agg(word, ' ') over (partition by doc_id order by pos rows between current row and 19 following)) as h from u),
m as (select *, pos <= n - 20 and row_number() over (partition by pos <= n - 20, h order by doc_id, pos) > 1 as again from h),
c as (select *, bool_or(again) over (partition by doc_id order by pos rows between 19 preceding and current row) as covered from m)
select d.doc_id, len(d.w) as n_words, coalesce(x.n_removed, 0) as n_removed, coalesce(x.kept_sha256, sha256('')) as kept_sha256 from d left join (
  select doc_id, count(*) filter (covered) as n_removed, sha256(coalesce(string_agg(word, ' ' order by pos) filter (not covered), '')) as kept_sha256 from c group by 1) x using (doc_id)
"""

OP9_SQL = rf"""
with recursive d as (select doc_id, text, regexp_extract_all({_LOW}, {_PLAIN}) as w from documents),
s as (select doc_id, list_sort(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] when text <> '' then [text] else [] end)) as s from d),
k as (select doc_id, len(s) as n, case when len(s) = 0 then doc_id else min(doc_id) over (partition by md5(array_to_string(s, chr(1)))) end as class_id, s from s),
g as (select class_id, n, unnest(s) as g from k where doc_id = class_id),
o as (select a.class_id as a, b.class_id as b, a.n as n, b.n as m, count(*) as c from g a join g b on a.g = b.g and a.class_id <> b.class_id group by 1, 2, 3, 4),
p as (select a, b from o where cast(c as double) / (n + m - c) >= 0.8),
weight as (select class_id, count(*) as weight from k group by 1),
links as (select a as class_id, sum(weight) as links from p join weight on p.b = weight.class_id group by 1),
r as (select class_id, class_id as root from weight union select p.b, r.root from r join p on p.a = r.class_id),
roots as (select class_id, min(root) as component_id from r group by 1)
select doc_id, class_id, cast(weight - 1 + coalesce(links, 0) as bigint) as n_links, component_id, doc_id = component_id as kept
from k join weight using (class_id) join roots using (class_id) left join links using (class_id)
"""

OP11_SQL = rf"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex({_LOW}, '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]'), lambda x: x <> '') as w from p),
t as (select lang, sum(len(w))::bigint as n from w group by 1),
f as (select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase, count(*) as f from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from w, range(1, 6) r(m)) group by 1, 2, 3),
c as (select lang, phrase, string_split(phrase, ' ') as w, f as a from f where m > 1 and f >= 100),
k as (select lang, phrase, w, a, unnest(range(1, len(w))) as k from c),
s as (select k.lang, k.phrase, a, k, l.f as l, r.f as r, n, ((1000::hugeint * a * n) // (l.f::hugeint * r.f))::bigint as score from k join t using (lang)
  join f l on l.lang = k.lang and l.phrase = array_to_string(w[1:k], ' ') join f r on r.lang = k.lang and r.phrase = array_to_string(w[k + 1:], ' ')),
b as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as place from s) where place = 1),
i as (select lang, array_to_string(w[x:x + m - 1], ' ') as phrase, max(a) as longest from (select lang, w, a, m, unnest(range(1, len(w) - m + 2)) as x from c, range(2, 5) r(m) where m < len(w)) group by 1, 2),
o as (select b.*, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b left join i using (lang, phrase) where longest is null or longest < a)
select lang, rank, phrase, a, l, r, n, score from o where rank <= 2000
"""

_H = "('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), {}, 8))::bigint"
OP12_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, {_H.format(1)} as h1, {_H.format(9)} as h2, {_H.format(25)} as h4 from documents),
c as (select *, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b, case when text = '' or regexp_matches(text, '<P>|<S>|<M>') then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from d),
p as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s from c)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256 from p
"""

ORACLE_SQL = {
    "op1_license_scan": OP1_SQL, "op4_embedding_near_dedup": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op9_ngram_jaccard_join": OP9_SQL, "op10_tool_call_linking": OP10_SQL,
    "op11_phrase_collocations": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "document_fingerprint_links": OP9_SQL,
}
