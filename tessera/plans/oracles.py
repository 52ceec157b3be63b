"""DuckDB SQL that gives the rows of the queries, written independently of them."""

from __future__ import annotations

from ..functions.text import COMMON_PARAMETERS, STOP_WORDS
from .corpora import CORRECTABLE, GT_PARSED, LINE_PAIRS, LOG_EVENTS, MERGING, MODEL_ANSWERS, RAW_LINES, TEMPLATE_PAIRS, TEMPLATE_VALUES, TREE_TEMPLATES

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_DOC_LINES = "select doc_id * 100000 + ln as line_id, line as content from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as ln from documents)"


def _tokens(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda t: t <> '')"


def _informative(x: str) -> str:
    return f"list_filter({_tokens(x)}, lambda t: length(t) > 2 and t not in ({_STOP}))"


def _set(x: str) -> str:
    return f"list_distinct({x})"


def _jaccard(a: str, b: str) -> str:
    return f"(cast(len(list_intersect({_set(a)}, {_set(b)})) as double) / len(list_distinct(list_concat({a}, {b}))))"


def _message_tokens(x: str) -> str:
    """Pieces between and of delimiters, without other punctuation; a piece with a wildcard is one; no two in a row."""
    inner = r" ,!;:=|\"''\[\](){}.\-+@#$%&"
    bare = r"regexp_replace(trim(t), '[!-''*-/:;<>?@\[-`{}~]', '', 'g')"
    parts = f"list_filter(list_transform(regexp_extract_all({x}, '[{inner}]|[^{inner}]+'), lambda t: case when t like '%<*>%' then '<*>' else {bare} end), lambda t: t <> '')"
    return f"list_filter({parts}, lambda t, k: t <> '<*>' or k = 1 or ({parts})[k - 1] <> '<*>')"


#: Distinct lines of log_events with their clusters: table c, and the anchors: table an.
_CLUSTERED = f"""
with l as ({LOG_EVENTS}),
d as (select content, min(line_id) as first_line, count(*) as weight, len({_tokens('content')}) as n_tokens from l group by content),
b as (select *, dense_rank() over (order by n_tokens) - 1 as cid1 from d),
o as (select cid1, first_line, weight, unnest({_informative('content')}) as token, unnest(range(len({_informative('content')}))) as pos from b),
v as (select cid1, token, sum(weight) as cnt from o group by 1, 2),
p as (select cid1, first_line, token, min(pos) as pos from o group by 1, 2, 3),
s as (select first_line, list(token order by cnt desc, pos)[1:3] as sig from p join v using (cid1, token) group by 1),
g as (select b.*, coalesce(sig, []) as sig from b left join s using (first_line)),
s3 as (select cid1, sig, sum(weight) as n, min(first_line) as sig_first from g group by 1, 2),
l3 as (select *, case when sum(n) over (partition by cid1, sig[1:3]) >= 100 then 3 else 0 end as level from s3),
l2 as (select * exclude (level), case when level = 0 and sum(case when level = 0 then n else 0 end) over (partition by cid1, sig[1:2]) >= 100 then 2 else level end as level from l3),
l1 as (select * exclude (level), case when level = 0 and sum(case when level = 0 then n else 0 end) over (partition by cid1, sig[1:1]) >= 100 then 1 else level end as level from l2),
k as (select cid1, sig, sig_first, level, case when level = 0 then '' else array_to_string(sig[1:level], ' ') end as prefix from l1),
q as (select g.*, k.sig_first, k.level, k.prefix from g join k using (cid1, sig)),
u as (select cid1, level, prefix, row_number() over (order by cid1, level desc, min(first_line)) - 1 as cid2 from q group by 1, 2, 3),
c as (select q.*, u.cid2 from q join u using (cid1, level, prefix)),
an as (select cid2, arg_min(content, (sig_first, first_line)) as anchor from c group by 1),
sm as (select c.*, an.anchor, {_jaccard(_tokens('an.anchor'), _tokens('c.content'))} as sim from c join an using (cid2)),
po as (select * from (select *, row_number() over (partition by cid2, sim order by sig_first, first_line) as r from sm where sim < 1 and sim >= 0.5) where r <= 3)
"""

#: Lines with templates of as many tokens that cover them: table m.
_MATCHED = rf"""
with l as ({LOG_EVENTS}),
t as (select template, {_tokens('template')} as tt, concat('^', replace(regexp_replace(regexp_replace(regexp_replace(template, '<.{{1,5}}>', '<*>', 'g'), '([^A-Za-z0-9])', '\\\1', 'g'), '\\ +', '\\s+', 'g'), '\<\*\>', '(.*?)'), '$') as pat
      from (values {TEMPLATE_VALUES}) v(template)),
ll as (select *, {_tokens('content')} as lt from l),
m as (select line_id, content, template, pat, tt, lt from ll join t on len(lt) = len(tt)
      and (tt[1] like '%<*>%' or tt[1] = lt[1]) and (tt[len(tt)] like '%<*>%' or tt[len(tt)] = lt[len(lt)]) and regexp_matches(content, pat))
"""

_METRICS = """
cells as (select gt, parsed, count(*) as n from gp group by 1, 2),
w as (select *, n = sum(n) over (partition by gt) and n = sum(n) over (partition by parsed) as whole, count(*) over (partition by parsed) = 1 as alone from cells)
"""


def _measures(source: str = "w") -> str:
    return f"""
select count(distinct parsed) as p, count(distinct gt) as g, coalesce(sum(n), 0) as lines, coalesce(sum(n) filter (whole), 0) as ga, count(*) filter (whole) as groups,
  coalesce(sum(n) filter (gt = parsed), 0) as pa, count(*) filter (gt = parsed and alone) as ta from {source}"""


_RATES = """
select p as identified_templates, g as ground_templates, coalesce(cast(ga as double) / nullif(lines, 0), 0) as GA, coalesce(cast(groups as double) / nullif(p, 0), 0) as PGA, coalesce(cast(groups as double) / nullif(g, 0), 0) as RGA,
  coalesce(2.0 * groups / nullif(p + g, 0), 0) as FGA, coalesce(cast(pa as double) / nullif(lines, 0), 0) as PA, coalesce(cast(ta as double) / nullif(p, 0), 0) as PTA, coalesce(cast(ta as double) / nullif(g, 0), 0) as RTA, coalesce(2.0 * ta / nullif(p + g, 0), 0) as FTA
"""
_ALL = f"with gp as ({GT_PARSED}), {_METRICS}, r as ({_RATES} from ({_measures()}))"
_FREQUENT = "select gt from (select gt, row_number() over (order by sum(n) {0}, gt) as k, count(*) over () as a from cells group by gt) where k <= floor(a * 40 / 100.0)"


def _slice(name: str, only: str) -> str:
    return f"select '{name}' as slice, identified_templates, ground_templates, round(GA, 6) as GA, round(PA, 6) as PA, round(FTA, 6) as FTA from ({_RATES} from ({_measures(f'(select * from w where gt in ({only}))')}))"


_COMPLEXITY = "case when length(gt) - length(replace(gt, '>', '')) = 0 then 1 when length(gt) - length(replace(gt, '>', '')) < 5 then 2 else 3 end"
_SUMMARY_COLUMNS = ("identified_templates", "ground_templates", "GA", "PA", "FGA", "PTA", "RTA", "FTA")
_V = r"<\*>"


def _replaced(x: str, *rules: tuple[str, str]) -> str:
    for old, new in rules:
        x = f"regexp_replace({x}, '{old}', '{new}', 'g')"
    return x


def _chain(link: str) -> tuple[str, str]:
    return rf"{_V}(?:{link}{_V})+", "<*>"


def _between(inner: str) -> tuple[tuple[str, str], ...]:
    """Twice, as neighbours share a space."""
    return ((f" {inner} ", " <*> "),) * 2


_CHAINS = _replaced(
    "template", _chain(r"\."), (f"({_V})+", "<*>"), *_between(f"#{_V}#"), *_between(f"#{_V}"), *(_chain(c) for c in (":", "#", "/", "@", r"\.")), *_between(f'"{_V}"'), *_between(f"''{_V}''"), (f"({_V})+", "<*>"), *_between(rf"{_V}\."), *_between(f"{_V},"),
    _chain(r"\+"), _chain("##"), ("#<\\*>#", "<*>"), _chain("-"), (f" {_V}(?: {_V})+ ", " <*> "), (f" {_V}(?: {_V})+$", " <*>"), (f"^{_V} (?:{_V} )+", "<*> "), _chain(","), (rf"\({_V}(?: {_V})+\)", "(<*>)"), *_between(f"/{_V}"), (f" /{_V}$", " <*>"),
)
_CUT = r"[\s,!;:=|\"''\[\](){}.\-+@#$%&]"
_CUTS = r"[\s,!;:=|\"''\[\](){}.\-+@#$%&]|[^\s,!;:=|\"''\[\](){}.\-+@#$%&]+"


def _common(x: str) -> str:
    for p in COMMON_PARAMETERS:
        x = f"regexp_replace({x}, '{p}', '<*>')"
    return x


_CUSTOMER = "select c_custkey, case c_custkey % 6 when 0 then c_name when 1 then concat('10.0.', cast(c_custkey % 300 as string), '.7') when 2 then concat(cast(c_custkey % 14 as string), ':05 PM') when 3 then concat('+4930', cast(c_custkey as string)) when 4 then concat('2024-', cast(10 + c_custkey % 5 as string), '-11') else concat('www.shop', cast(c_custkey as string), '.com/x 0x1F') end as s from customer"
_LETTERS = "select a.n_name as x, b.n_name as y from nation a join nation b on a.n_regionkey = b.n_regionkey"
#: What mining makes of the kinds of events, from the lines: a token that all lines of a kind have at a place stays, others are wildcards.
_MINED = f"""select line_id, template from (select l.line_id, e.event_type from ({LOG_EVENTS}) l join events e on e.event_id = l.line_id) k join (
  select event_type, string_agg(case when kinds = 1 then token else '<*>' end, ' ' order by place) as template from (
    select event_type, place, count(distinct token) as kinds, min(token) as token from (
      select e.event_type, unnest({_tokens('l.content')}) as token, unnest(range(len({_tokens('l.content')}))) as place from ({LOG_EVENTS}) l join events e on e.event_id = l.line_id) group by 1, 2) group by 1) t using (event_type)"""
_VARIABLE = "regexp_matches(replace(content, '<*>', ''), '[^ A-Za-z!]')"


def _others(x: str) -> str:
    return f"list_distinct(list_filter(string_split(regexp_replace({x}, '[A-Za-z]', '', 'g'), ''), lambda c: c <> ''))"


def _covers(template: str, line: str) -> str:
    """A template with wildcards covers a line: end tokens, then the pattern."""
    pattern = rf"concat('^', replace(regexp_replace(regexp_replace({template}, '([^A-Za-z0-9])', '\\\1', 'g'), '\\ +', '\\s+', 'g'), '\<\*\>', '.*?'), '$')"
    ends = " and ".join(f"({t} like '%<*>%' or {t} = {x})" for t, x in ((f"string_split({template}, ' ')[{k}]", f"string_split({line}, ' ')[{k}]") for k in (1, -1)))
    return f"({ends} and regexp_matches({line}, {pattern}))"


#: Pairs of templates: tokens of pairs u, v merged by ends and by character: table w; merged templates: table f.
_MERGED = rf"""
with p as ({TEMPLATE_PAIRS}), t as (select line_id, x, y, string_split(x, ' ') as a, string_split(y, ' ') as b from p),
k as (select line_id, pos, a[pos] as u, b[pos] as v from t, range(1, 20) r(pos) where len(a) = len(b) and pos <= len(a)),
e as (select u, v, replace(u, '<*>', chr(0)) as x, replace(v, '<*>', chr(0)) as y, {_others("replace(u, '<*>', chr(0))")} as dx, {_others("replace(v, '<*>', chr(0))")} as dy from (select u, v from k union select a[2], b[2] from t)),
q as (select *, regexp_full_match(x, '[A-Z]*') and regexp_full_match(y, '[A-Z]*') or len(dx) > 0 and len(dy) > 0 and not (len(dx) = 1 and len(dy) = 1 and (dx[1] = dy[1] and dx[1] in ('.', '_') or dx[1] = ':' and dy[1] = ':' and x like '%:' and y like '%:'))
  and not (len(dx) = 2 and len(dy) = 2 and x like '%()' and y like '%()') and x not like '%.....%' and y not like '%.....%' as variable, len(list_filter(range(1, least(length(u), length(v)) + 1), lambda i: u[1:i] = v[1:i])) as head from e),
r as (select *, u[head + 1:] as ru, v[head + 1:] as rv from q), h as (select *, len(list_filter(range(1, least(length(ru), length(rv)) + 1), lambda i: right(ru, i) = right(rv, i))) as tail from r),
w as (select u, v, variable, case when u = '<*>' or v = '<*>' then '<*>' when variable then regexp_replace(concat(u[1:head], '<*>', right(u, tail)), '(<\*>)+', '<*>', 'g') end as by_ends, case when u = '<*>' or v = '<*>' then '<*>' when variable then
  regexp_replace(array_to_string(list_transform(range(1, greatest(length(x), length(y)) + 1), lambda i: case when i > length(x) then y[i] when i > length(y) or x[i] = y[i] then x[i] else chr(0) end), ''), '\x00+', '<*>', 'g') end as by_character from h),
j as (select line_id, bool_or(u <> v and by_ends is not null) as edits, string_agg(case when u = v then u else coalesce(by_ends, u) end, ' ' order by pos) as joined from k join w using (u, v) group by 1),
n as (select line_id, edits, array_to_string(list_transform(regexp_extract_all(joined, '{_CUTS}'), lambda i: case when regexp_matches(i, '^[0-9]+$') or regexp_matches(i, '^0x[0-9a-fA-F]+') or regexp_matches(i, '^[^\s/]*<\*>[^\s/]*$') then '<*>' else i end), '') as template from j),
c as (select line_id, edits, {_CHAINS} as m from n), f as (select line_id, case when a = b then x when edits and m <> '' and {_covers('m', 'x')} and {_covers('m', 'y')} then m end as merged from t left join c using (line_id))
"""
_HEAD = "list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i] and not list_contains(a[1:i], '<*>'))"
#: Templates of the tree as patterns of tokens that are followed by chr(1) each, their beginnings, and lines as such tokens.
_TREE_VALUES = ", ".join(f"('{t}')" for t in TREE_TEMPLATES)
_CUT_TOKENS = "array_to_string(list_transform({}, lambda i: concat(i, chr(1))), '')"
_TREE = rf"""
with v as (select template, {_message_tokens('template')} as w from (values {_TREE_VALUES}) v(template)), x as (select line_id, {_CUT_TOKENS.format(_message_tokens('content'))} as text from ({LOG_EVENTS})),
t as (select template, len(list_filter(w, lambda i: i = '<*>')) as wild, len(list_filter(w, lambda i: i <> '<*>')) as fixed, list_transform(string_split({_CUT_TOKENS.format('w')}, concat('<*>', chr(1))), lambda i: regexp_replace(i, '([^A-Za-z0-9\x01])', '\\\1', 'g')) as parts from v),
h as (select line_id, text, template, wild, fixed, concat('^', array_to_string(parts, '((?:[^\x01]+\x01)*?)'), '$') as pat from x, t where regexp_matches(text, concat('^', array_to_string(parts, '((?:[^\x01]+\x01)*?)'), '$'))),
b as (select *, row_number() over (partition by line_id order by fixed desc, wild, template) as place from h),
n as (select template, k, parts[1:k] as node, concat('^', array_to_string(parts[1:k], '(?:[^\x01]+\x01)*?')) as pat from t, range(1, 10) r(k) where k < len(parts)),
a as (select distinct line_id, node from x, (select distinct node, pat from n) m where regexp_matches(text, pat)),
d as (select line_id, node from a where (line_id, node) not in (select (line_id, node[1:len(node) - 1]) from a) and line_id not in (select line_id from h))
"""
_WEIGHTED = "round(0.6::double * (list_sum(vs) / len(vs)) + (1 - 0.6::double) * (case when len(vs) < 2 then 0 else list_sum(list_transform(range(1, len(vs)), lambda i: list_sum(list_transform(vs[i + 1:], lambda z: z - vs[i])))) / (len(vs) * (len(vs) - 1) / 2) end), 9)"

ORACLE_SQL: dict[str, str] = {
    "mask_regex": "select page_id, regexp_replace(regexp_replace(regexp_replace(url, '[0-9]+', '<*>', 'g'), 'https?://[a-z.]*', '<*>', 'g'), 'utm_[a-z]+', '<*>', 'g') as masked from pages",
    "mask_common_params": f"select c_custkey, {_common('s')} as masked, regexp_replace(s, '0x[0-9a-fA-F]+', '<*>', 'g') as hex from ({_CUSTOMER})",
    "parse_log_format": r"""select line_id, regexp_extract(line, p, 1) as "time", regexp_extract(line, p, 2) as "level", regexp_extract(line, p, 3) as content from (
      select event_id as line_id, concat('[', strftime(ts, '%Y-%m-%d %H:%M:%S'), '] [', event_type, '] user ', cast(user_id as string), ' props ', props) as line, '^\[(.*?)\]\s+\[(.*?)\]\s+(.*?)$' as p from events)""".replace("regexp_extract(line, p,", r"regexp_extract(line, '^\[(.*?)\]\s+\[(.*?)\]\s+(.*?)$',"),
    "token_length_hist": f"select len({_tokens('content')}) as n_tokens, count(*) as n_lines from ({_DOC_LINES}) group by 1",
    "length_bucket_ids": f"select n_tokens, dense_rank() over (order by n_tokens) - 1 as cid1, n_lines from (select len({_tokens('content')}) as n_tokens, count(*) as n_lines from ({_DOC_LINES}) group by 1)",
    "vocab_by_length": f"select cid1, token, count(*) as cnt from (select dense_rank() over (order by len({_tokens('content')})) - 1 as cid1, {_informative('content')} as ts from ({_DOC_LINES})), unnest(ts) as u(token) group by 1, 2",
    "topk_signature": _CLUSTERED + "select first_line, array_to_string(sig, ' ') as sig from g",
    "prefix_clusters": _CLUSTERED + "select cid1, cast(level as bigint) as level, prefix, cast(sum(weight) as bigint) as n_lines from c group by 1, 2, 3",
    "cluster_ids": _CLUSTERED + "select cid2, cid1, cast(sum(weight) as bigint) as n_lines from c group by 1, 2",
    "anchor_per_cluster": _CLUSTERED + "select cid2, anchor from an",
    "largest_cluster": _CLUSTERED + "select cid1, cid2 from (select cid1, cid2, row_number() over (partition by cid1 order by sum(weight) desc, cid2) as r from c group by 1, 2) where r = 1",
    "adaptive_sample_size": f"select {_VARIABLE} as variable, cast(case when not {_VARIABLE} and len({_tokens('content')}) <= 5 then 1 else 3 end as bigint) as size, count(*) as n_lines from ({_DOC_LINES}) group by 1, 2",
    "jaccard_to_anchor": _CLUSTERED + "select cid2, round(sim, 6) as sim, cast(sum(weight) as bigint) as n_lines from sm group by 1, 2",
    "candidate_pool": _CLUSTERED + "select cid2, content, round(sim, 6) as sim from po",
    "contrast_best_pair": _CLUSTERED
    + f""", pr as (select a.cid2, a.content as first, b.content as second, a.sim as x, b.sim as y, {_jaccard(_tokens('a.content'), _tokens('b.content'))} as z, a.sig_first as af, a.first_line as al, b.sig_first as bf, b.first_line as bl
      from po a join po b on a.cid2 = b.cid2 and (a.sig_first, a.first_line) < (b.sig_first, b.first_line)),
    sc as (select *, cast(0.6 as double) * ((x + y + z) / 3) + (1 - cast(0.6 as double)) * ((abs(x - y) + abs(x - z) + abs(y - z)) / 3) as score from pr)
    select cid2, first, second, round(score, 6) as score from (select *, row_number() over (partition by cid2 order by score, af, al, bf, bl) as r from sc) where r = 1""",
    "shared_words_top": _CLUSTERED + f"select cid2, content, words from (select *, row_number() over (partition by cid2 order by words desc, first_line) as r from (select *, len(list_intersect({_set(_tokens('anchor'))}, {_set(_tokens('content'))})) as words from sm where content <> anchor)) where r < 3",
    "first_lines_padded": _CLUSTERED + ", f as (select cid2, list(content order by sig_first, first_line)[1:3] as s from c group by 1) select cid2, concat(s[1], ' | ', s[1 + 1 % len(s)], ' | ', s[1 + 2 % len(s)]) as sample from f",
    "hamming_words": _CLUSTERED + f"select cid2, len(list_filter(list_zip({_tokens('anchor')}, {_tokens('content')}), lambda z: z[1] is distinct from z[2])) as distance, cast(sum(weight) as bigint) as n_lines from sm group by 1, 2",
    "common_subsequence_words": f"""with p as ({_LETTERS}), u as (select distinct n_name as name, array_to_string(list_filter(string_split(n_name, ''), lambda c, i: (m >> (i - 1)) & 1 = 1), '') as s from nation, range(1::bigint << (select max(length(n_name)) from nation)) r(m) where m < 1::bigint << length(n_name)),
      l as (select x, y, max(length(a.s)) as subsequence from p join u a on a.name = x join u b on b.name = y and a.s = b.s group by 1, 2),
      w as (select x, y, i, n, x[i:i + n - 1] as run from p, range(1, length(x) + 1) t(i), range(1, length(x) - i + 2) q(n)), c as (select x, y, arg_min(run, (-n, i)) as run from w where contains(y, run) group by 1, 2)
      select p.x, p.y, subsequence, coalesce(run, '') as run, x[1:len(list_filter(range(1, least(length(p.x), length(p.y)) + 1), lambda k: p.x[1:k] = p.y[1:k]))] as prefix, right(p.x, len(list_filter(range(1, least(length(p.x), length(p.y)) + 1), lambda k: right(p.x, k) = right(p.y, k)))) as suffix
      from p join l using (x, y) left join c using (x, y)""",
    "edit_distance_words": f"select x, y, levenshtein(x, y) as distance from ({_LETTERS})",
    "normalize_tokens": rf"""select line_id, array_to_string(list_transform(regexp_extract_all(regexp_replace(regexp_replace(content, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '{_CUTS}'),
      lambda t: case when regexp_matches(t, '^[0-9]+$') or regexp_matches(t, '^0x[0-9a-fA-F]+') or regexp_matches(t, '^[^\s/]*<\*>[^\s/]*$') then '<*>' else t end), '') as normalized from ({LOG_EVENTS})""",
    "normalize_pairs": "select case when (length(t) - length(replace(t, '=<*>', ''))) >= 12 then replace(t, '= ', '=<*> ') else t end as normalized, count(*) as n_lines from (select concat('a=<*> b=<*> c', case when event_id % 2 = 0 then '=<*>' else '' end, ' d= x e= y') as t from events) group by 1",
    "template_match": _MATCHED + "select line_id, template from m",
    "unmatched_lines": _MATCHED + "select line_id, content from l where line_id not in (select line_id from m where template like 'User%' or template like 'Handled signup%')",
    "constant_match": _MATCHED + "select template, count(*) as n_lines from m where len(list_filter(tt, lambda x: x not like '%<*>%' and not list_contains(lt, x))) = 0 group by 1",
    "best_template": _MATCHED + "select line_id, template from (select *, row_number() over (partition by line_id order by length(replace(template, '<*>', '')) desc, template) as r from m) where r = 1",
    "majority_template": f"""with gp as ({GT_PARSED}), r as (select gt, parsed, count(*) as n, min(line_id) as f from gp group by 1, 2)
      select gt, arg_max(parsed, (n, -f)) as majority, arg_min(parsed, f) as first, sum(n) > 1 and count(*) / sum(n) >= 0.8 as diverse from r group by 1""",
    "assign_event_ids": f"with gp as ({GT_PARSED}), e as (select parsed, concat('E', row_number() over (order by min(line_id))) as event_id from gp group by 1) select line_id, parsed as template, event_id from gp join e using (parsed)",
    "template_table": f"with gp as ({GT_PARSED}) select concat('E', row_number() over (order by min(line_id))) as event_id, parsed as template, count(*) as occurrences from gp group by parsed",
    "eval_ga": _ALL + "select round(GA, 6) as GA, round(PGA, 6) as PGA, round(RGA, 6) as RGA, round(FGA, 6) as FGA from r",
    "eval_pa": _ALL + "select round(PA, 6) as PA from r",
    "eval_fta": _ALL + "select round(PTA, 6) as PTA, round(RTA, 6) as RTA, round(FTA, 6) as FTA from r",
    "eval_complexity_slices": _ALL + " union all ".join(_slice(str(k), f"select gt from cells where {_COMPLEXITY} = {k}") for k in (1, 2, 3)),
    "eval_frequency_slices": _ALL + " union all ".join(_slice(n, _FREQUENT.format(o)) for n, o in (("40", "asc"), ("-40", "desc"))),
    "metric_summary": _ALL
    + f", f as ({_RATES} from ({_measures(f'(select * from w where gt in ({_FREQUENT.format("desc")}))')})), d as (select 'all' as dataset, * from r union all select 'frequent', * from f), "
    + "a as (select * from d union all select 'Average', " + ", ".join(f"avg({c})" for c in ("identified_templates", "ground_templates", "GA", "PGA", "RGA", "FGA", "PA", "PTA", "RTA", "FTA")) + " from d) "
    + " union all ".join(f"select '{c}' as measure, dataset, round(cast({c} as double), 3) as value from a" for c in _SUMMARY_COLUMNS),
    "group_errors": _ALL
    + ", x as (select parsed, count(*) as groups, bool_and(complete) as complete from (select *, n = sum(n) over (partition by gt) as complete from cells) group by 1) "
    + "select parsed, case when groups = 1 and complete then 'accurate' when groups = 1 then 'over' when complete then 'under' else 'mixed' end as kind from x",
    "extract_params": _MATCHED
    + """, x as (select *, (length(pat) - length(replace(pat, '(.*?)', ''))) // 5 as n from m)
      select line_id, template, concat_ws(' | ', regexp_extract(content, pat, 1), case when n > 1 then regexp_extract(content, pat, 2) end, case when n > 2 then regexp_extract(content, pat, 3) end, case when n > 3 then regexp_extract(content, pat, 4) end) as params from x""",
    "log_template_counts": f"select template, count(*) as n_lines from ({_MINED}) group by 1",
    "mine_templates": f"with m as ({_MINED}), e as (select template, concat('E', row_number() over (order by min(line_id))) as event_id from m group by 1) select line_id, template, event_id from m join e using (template)",
    "mined_quality": f"with gp as (select gt, template as parsed from ({GT_PARSED}) g join ({_MINED}) m using (line_id)), {_METRICS}, r as ({_RATES} from ({_measures()})) select round(GA, 6) as GA, round(PGA, 6) as PGA, round(RGA, 6) as RGA, round(FGA, 6) as FGA from r",
    "line_gates": f"""with p as (select line_id, string_split(x, ' ') as a, string_split(y, ' ') as b from ({LINE_PAIRS})), d as (select line_id, len(a) as n, len(b) as m, len(list_filter(list_zip(a, b), lambda z: z[1] is distinct from z[2])) as d from p)
      select line_id, n = m and (d <= 1 or d = 2 and n > 10) as may_merge, n = m and d < 0.2 * n as by_share from d""",
    "line_contrast": f"""with p as (select line_id, {_tokens('x')} as a, {_tokens('y')} as b, {_tokens('z')} as c from ({LINE_PAIRS})), j as (select line_id, {_jaccard('a', 'b')} as u, {_jaccard('a', 'c')} as v, {_jaccard('b', 'c')} as w, list_filter(a, lambda t: not regexp_matches(t, '[0-9]')) as d, list_filter(b, lambda t: not regexp_matches(t, '[0-9]')) as e from p)
      select line_id, round(0.6::double * ((u + v) / 2) + (1 - 0.6::double) * abs(u - v), 6) as to_first, round(0.6::double * ((u + v) / 2) + (1 - 0.6::double) * ((abs(u - v) + abs(u - w) + abs(v - w)) / 3), 6) as mixed, round({_jaccard('d', 'e')}, 6) as masked from j""",
    "variable_tokens": f"""with t as (select unnest({_tokens('content')}) as token from (select content from ({LOG_EVENTS}) union all select content from ({_DOC_LINES}))), g as (select token, count(*) as n from t group by 1),
      d as (select *, replace(token, '<*>', chr(0)) as m from g), o as (select *, list_distinct(list_filter(string_split(regexp_replace(m, '[A-Za-z]', '', 'g'), ''), lambda c: c <> '')) as d, list_distinct(list_filter(string_split(regexp_replace(token, '[A-Za-z]', '', 'g'), ''), lambda c: c <> '')) as own from d)
      select token, n, regexp_full_match(m, '[A-Z]*') or (len(d) > 0 and not (len(d) = 1 and (d[1] in ('.', '_') or m like '%:')) and not (len(d) = 2 and m like '%()') and m not like '%.....%') as variable, len(own) > 0 as naive,
        regexp_matches(token, '[0-9]') and regexp_matches(token, '[^0-9A-Za-z_]') and regexp_matches(token, '[A-Za-z]') as rich from o""",
    "abstract_match": rf"""with t as (select template, len({_tokens('template')}) as n, concat('^', replace(regexp_replace(regexp_replace(template, '([^A-Za-z0-9])', '\\\1', 'g'), '\\ +', '\\s+', 'g'), '\<\*\>', '(\S+?)'), '$') as pat from (values {TEMPLATE_VALUES}) v(template))
      select template, count(*) as n_lines from ({LOG_EVENTS}) l join t on len({_tokens('content')}) = n where regexp_matches(content, pat) group by 1""",
    "answers_of_events": f"""select id, case id % 5 when 0 then concat('1=', event_type, ' {{id}}|2=', props) when 1 then concat('-1=', event_type) when 2 then concat('2=', props, '|-1=a=`1') else '' end as parsed,
      case id % 5 when 0 then concat(event_type, ' {{id}}|', props) when 2 then concat(props, '|', props) else 'first|second' end as filled, regexp_replace(answer, '^\\s+|\\s+$', '', 'g') as plain from ({MODEL_ANSWERS}) a join events e on e.event_id = a.id""",
    "requests_of_lines": f"""select line_id, concat('Log[1]: `', x, '`', chr(10), 'Log[2]: `', y, '`') as asked, 2::bigint as messages, case when len({_tokens('x')}) <= 2 and len({_tokens('y')}) <= 2 then 1 else 3 end::bigint as tries, case when len({_tokens('x')}) <= 5 then 1 else 3 end::bigint as tries_alone from ({LINE_PAIRS})""",
    "pipe_tables": "select n_nationkey, row::bigint as row, case row when 0 then 'key;name' when 1 then concat(n_nationkey, ';', n_name) else concat(n_regionkey, ';') end as cells from nation, range(3) r(row)",
    "merged_ids": "select user_id, coalesce(string_agg(event_id::varchar, ',' order by event_id) filter (event_type = 'error' or event_id % 2 = 0), '') as ids from events group by 1",
    "aligned_accuracy": f"with gp as (select gt, parsed from ({GT_PARSED}) where line_id % 3 <> 0), {_METRICS}, r as ({_RATES} from ({_measures()})) select round(GA, 6) as GA, round(PA, 6) as PA, round(FTA, 6) as FTA from r",
    "sorted_templates": f"select row_number() over (order by length(parsed) desc, parsed) - 1 as place, parsed as template from (select distinct parsed from ({GT_PARSED}))",
    "normalize_lines": f"""select line_id, {_CHAINS} as normalized, not regexp_matches(replace(template, '<*>', ''), '[^ [:punct:]]') as too_general, template <> '' and (length(template) - length(replace(template, '<*>', ''))) / 3 <= 50 as valid,
      cast((length(template) - length(replace(template, '<*>', ''))) // 3 as bigint) as wildcards, cast({_COMPLEXITY.replace('(gt', '(template')} as bigint) as complexity from ({RAW_LINES.format(flags=", 'g'")})""",
    "parsed_similarities": f"""with b as (select gt, parsed, count(*) as n_lines, string_split(gt, ' ') as v, string_split(parsed, ' ') as w from ({GT_PARSED}) group by 1, 2), c as (select *, len(v) as n1, len(w) as n2, cast(len(list_intersect(list_distinct(v), list_distinct(w))) as double) as i, len(list_distinct(list_concat(v, w))) as u from b)
      select gt, parsed, n_lines, round(i / u, 6) as jaccard, round((i + 1e-5) / (u + 1e-5), 6) as smoothed, round((i + 1e-5) / (u + 1e-5) * pow(n1 * n2 / 400.0, 2), 6) as weighted, round(i / (n1 + n2 - i), 6) as similarity from c""",
    "metric_table": _ALL
    + f", f as ({_RATES} from ({_measures(f'(select * from w where gt in ({_FREQUENT.format("desc")}))')})), d as (select 'all' as dataset, * from r union all select 'frequent', * from f) "
    + " union all ".join("select " + x + " as dataset, " + ", ".join(f"round({g.format(c)}, 3) as {c}" for c in _SUMMARY_COLUMNS) + " from " + y for x, g, y in (("dataset", "cast({} as double)", "d"), ("'Average'", "avg({})", "d"), ("'absent'", "null::double + 0 * {}", "(select * from d limit 1)"))),
    "similarity_accuracy": rf"""with gp as ({GT_PARSED}), c as (select gt, parsed, count(*) as n from gp group by 1, 2),
      w as (select n, {_message_tokens('gt')} as a, {_message_tokens('parsed')} as b from c), i as (select *, len(list_intersect(list_distinct(a), list_distinct(b))) as i from w)
      select round(sum(n * (cast(i as double) / (len(a) + len(b) - i))) / sum(n), 6) as SA from i""",
    "labels_by_content": "with l as (select event_type as content, concat(event_type, ' ', max(event_id)) as template from events where event_type <> 'view' group by 1) select content, template, count(*) as n_lines from (select event_type as content from events) left join l using (content) group by 1, 2",
    "template_similarities": f"""with b as (select x, y, string_split(x, ' ') as v, string_split(y, ' ') as w from (select distinct x, y from ({TEMPLATE_PAIRS}))), c as (select *, len(v) as n1, len(w) as n2, cast(len(list_intersect(list_distinct(v), list_distinct(w))) as double) as i, len(list_distinct(list_concat(v, w))) as u from b)
      select x, y, round(i / u, 6) as jaccard, round((i + 1e-5) / (u + 1e-5), 6) as smoothed, round((i + 1e-5) / (u + 1e-5) * pow(n1 * n2 / 400.0, 2), 6) as weighted, round(i / (n1 + n2 - i), 6) as similarity from c""",
    "normalize_chains": f"select template, {_CHAINS} as normalized from (select replace(template, ' ', ' <*>') as template from ({RAW_LINES.format(flags=", 'g'")}) union select x from ({TEMPLATE_PAIRS}))",
    "template_checks": f"""select template, not regexp_matches(replace(template, '<*>', ''), '[^ [:punct:]]') as too_general, template <> '' and (length(template) - length(replace(template, '<*>', ''))) / 3 <= 50 as valid,
      cast((length(template) - length(replace(template, '<*>', ''))) // 3 as bigint) as wildcards, cast({_COMPLEXITY.replace('(gt', '(template')} as bigint) as complexity from (select regexp_replace(template, '[A-Za-z]', '', 'g') as template from ({RAW_LINES.format(flags=", 'g'")}) union select x from ({TEMPLATE_PAIRS}))""",
    "parse_answers": """select event_id as id, pos::bigint as pos, case when event_id % 5 = 0 then pos + 1 when event_id % 5 = 2 and pos = 0 then 2 else -1 end::bigint as idx, case when event_id % 5 = 0 and pos = 0 then concat(event_type, ' {id}') when event_id % 5 = 1 then event_type when event_id % 5 = 2 and pos = 1 then 'a=`1' else props end as template
      from events, range(2) r(pos) where event_id % 5 in (0, 2) or event_id % 5 = 1 and pos = 0""",
    "merge_gates": f"""with p as (select line_id, string_split(x, ' ') as a, string_split(y, ' ') as b from ({TEMPLATE_PAIRS})), u as (select *, list_distinct(list_concat(a, b)) as u, len(a) as n, len(b) as m, len(list_filter(list_zip(a, b), lambda z: z[1] is distinct from z[2])) as d from p),
      e as (select *, levenshtein(array_to_string(list_transform(a, lambda t: chr(64 + list_position(u, t)::int)), ''), array_to_string(list_transform(b, lambda t: chr(64 + list_position(u, t)::int)), '')) as e, (len(list_intersect(list_distinct(a), list_distinct(b))) + 1e-5) / (len(u) + 1e-5) as s from u)
      select line_id, n = m and (d <= 1 or d = 2 and n > 10) as may_merge, n = m and d < 0.2 * n as by_share, e <= 1 or s > 0.8 or n > 10 and m > 10 and e <= 0.3 * greatest(n, m) as by_distance from e""",
    "merge_pairs": _MERGED
    + f""", g as (select line_id, a, b, a[2] as u, b[2] as v, len({_HEAD}) as head from t), z as (select *, a[head + 1:] as a2, b[head + 1:] as b2 from g),
      y as (select *, len(list_filter(range(1, least(len(a2), len(b2)) + 1), lambda i: a2[len(a2) - i + 1:] = b2[len(b2) - i + 1:] and not list_contains(a2[len(a2) - i + 1:], '<*>'))) as tail from z)
      select line_id, merged, variable, by_ends, by_character, case when len(list_filter(a, lambda i: i = '<*>')) > 1 or len(list_filter(b, lambda i: i = '<*>')) > 1 then array_to_string(list_concat(a[1:head], ['<*>'], a[len(a) - tail + 1:]), ' ') end as by_lists
      from y join w using (u, v) join f using (line_id)""",
    "corrected_templates": f"select string_agg(event_id, ',' order by substr(event_id, 2)::bigint) as event_ids, template from (select event_id, case when template like 'path%' then 'path <*> ok' when template like 'user%' then 'user <*> in' when template like 'count%' then 'count <*> of <*>' else template end as template from ({CORRECTABLE})) group by 2",
    "corrected_lines": f"""with c as (select event_id, case when template like 'path%' then 'path <*> ok' when template like 'user%' then 'user <*> in' when template like 'count%' then 'count <*> of <*>' else template end as template from ({CORRECTABLE})),
      g as (select *, arg_min(event_id, substr(event_id, 2)::bigint) over (partition by template) as first from c) select coalesce(first, k) as event_id, coalesce(template, t) as template, count(*) as n_lines from (select concat('E', event_id % 200) as k, event_type as t from events) left join g on g.event_id = k group by 1, 2""",
    "similarity_matrix": f"""with l as (select x as content, min(line_id) as id from ({TEMPLATE_PAIRS}) where line_id % 10 = 1 group by 1), t as (select id, {_tokens('content')} as w from l), p as (select a.id as a, b.id as b, {_jaccard('a.w', 'b.w')} as sim from t a join t b on a.id < b.id)
      select a, b, round(sim, 6) as sim from p where sim > 0""",
    "eval_slices": _ALL + " union all ".join(_slice(n, o) for n, o in (("all", "select gt from cells"), *((f"complexity {k}", f"select gt from cells where {_COMPLEXITY} = {k}") for k in (1, 2, 3)), *((f"frequency {n}", _FREQUENT.format(o)) for n, o in (("40", "asc"), ("-40", "desc"))))),
    "tree_match": _TREE
    + r"""select line_id, template, true as matched, array_to_string(list_transform(range(1, wild + 1), lambda i: replace(case i when 1 then regexp_extract(text, pat, 1) when 2 then regexp_extract(text, pat, 2) else regexp_extract(text, pat, 3) end, chr(1), '')), '|') as params from b where place = 1
      union all select distinct line_id, template, false, null from d join n using (node)""",
    "line_sequences": f"""with recursive p as (select line_id, a, b from (select line_id, {_tokens('content')} as a, lead({_tokens('content')}) over (partition by line_id // 100000 order by line_id) as b from ({_DOC_LINES})) where b is not null),
      u as (select line_id, unnest(b) as y, unnest(range(1, len(b) + 1)) as j from p union all select line_id, null, 0 from p),
      r as (select line_id, 0 as i, j, 0 as lcs, j as ed, 0 as run from u union all
        select line_id, i + 1, j, max(best) over (partition by line_id order by j), j + min(fewest - j) over (partition by line_id order by j), run from (
          select r.line_id, r.i, r.j, case when y = x then coalesce(lag(lcs) over w, 0) + 1 else lcs end as best, case when j = 0 then r.i + 1 else least(ed + 1, lag(ed) over w + case when y = x then 0 else 1 end) end as fewest, case when y = x then coalesce(lag(run) over w, 0) + 1 else 0 end as run
          from (select r.*, u.y, p.a[r.i + 1] as x from r join p using (line_id) join u using (line_id, j) where r.i < len(p.a)) r window w as (partition by line_id order by j))),
      m as (select line_id, max(run) as n, arg_min(i - run, (-run, i - run)) as begin from r where run > 0 group by 1)
      select line_id, lcs as subsequence, lcs as words, ed as distance, coalesce(array_to_string(a[m.begin + 1:m.begin + n], ' '), '') as run from r join p using (line_id) left join m using (line_id) where r.i = len(a) and r.j = len(b)""",
    "similar_log_lines": f"""with s as (select list_sort(list_distinct({_tokens('content')})) as w, min(line_id) as id from ({LOG_EVENTS}) group by 1), e as (select id, len(w) as n, unnest(w) as t from s),
      c as (select x.id as a, y.id as b, x.n as n, y.n as m, count(*) as common from e x join e y on x.t = y.t and x.id < y.id and x.n >= 0.7 * y.n and y.n >= 0.7 * x.n group by 1, 2, 3, 4) select a, b, common, round(common / (n + m - common), 6) as sim from c where common / (n + m - common) >= 0.7 - 1e-12""",
    "contrast_best_samples": _CLUSTERED.replace("with l as", "with recursive l as", 1)
    + f""", pc as (select cid2, content, sim, row_number() over (partition by cid2 order by sig_first, first_line) as i, count(*) over (partition by cid2) as n from po),
      pp as (select a.cid2, a.i, b.i as j, {_jaccard(_tokens('a.content'), _tokens('b.content'))} as v from pc a join pc b on a.cid2 = b.cid2 and a.i < b.i),
      rc as (select cid2, [i] as m from pc union all select rc.cid2, list_append(rc.m, pc.i) from rc join pc on rc.cid2 = pc.cid2 and pc.i > rc.m[-1] where len(rc.m) < 4),
      mv as (select cid2, m, unnest(m) as i from rc), vs as (select cid2, m, list(v order by v) as vs from (select mv.cid2, m, sim as v from mv join pc using (cid2, i) union all select a.cid2, a.m, v from mv a join mv b on a.cid2 = b.cid2 and a.m = b.m and a.i < b.i join pp on pp.cid2 = a.cid2 and pp.i = a.i and pp.j = b.i) group by 1, 2),
      bs as (select cid2, m, score from (select *, row_number() over (partition by cid2, len(m) order by score, m) as place from (select cid2, m, {_WEIGHTED} as score from vs)) where place = 1),
      fw as (select distinct z.size - 1 as k, cid2, range(1, n + 1) as m, null::double as score from pc, range(2, 6) z(size) where n < z.size - 1), al as (select len(m) as k, cid2, m, score from bs union all select k, cid2, m, score from fw)
      select k + 1 as size, al.cid2, string_agg(content, ' | ' order by pc.i) as lines, round(score, 6) as score from al join pc on pc.cid2 = al.cid2 and list_contains(m, pc.i) group by k, al.cid2, score""",
    "merge_lineage": f"""with l as ({MERGING}), c as (select kind, dock, count(*) as n, min(line_id) as f from l group by 1, 2), o as (select *, row_number() over (partition by kind order by n desc, f) as place, sum(n) over (partition by kind) as lines from c),
      t as (select lines, concat(kind, ' <*> ', reverse(kind), ' by dock', dock, ' ', kind, 'x') as first, concat(kind, ' <*> ', reverse(kind), ' by <*> ', kind, 'x') as merged from o where place = 1)
      select first as template, 0::bigint as round, merged as merged_into, merged as root_template, 0::bigint as n_lines from t union all select merged, 1, null, merged, lines::bigint from t""",
}
