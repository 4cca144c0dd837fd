"""Plain SQL for the queries that SQL can express."""

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w : w <> '')"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_FREQUENCY = rf"""
with d as (
  select doc_id, coalesce('h' || source, 'none') as host, coalesce(text, '') as text, {WORDS} as w from documents),
windows as (
  select doc_id, i, array_to_string(w[i : i + 7], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d)),
twice as (select doc_id, i, count(*) over (partition by doc_id, s) as n from windows),
covered as (
  select doc_id, count(distinct pos) as n_repeat_words
  from (select doc_id, unnest(range(i, i + 8)) as pos from twice where n > 1) group by doc_id),
lines as (
  select doc_id, host, text, unnest(list_filter(string_split(text, chr(10)), lambda x : regexp_matches(x, '[^\x20\x09-\x0D]'))) as line from d),
plain as (
  select doc_id, host, text,
         list_filter(regexp_split_to_array(translate(lower(line), '123456789', '000000000'), '[\x20\x09-\x0D]+'), lambda w : w <> '') as lw
  from lines),
sizes as (select host, count(distinct text) as host_docs from d group by host),
frequent as (
  select p.host, array_to_string(lw, ' ') as line from plain p join sizes s on p.host = s.host
  group by p.host, array_to_string(lw, ' '), host_docs
  having count(distinct text) > 20 and count(distinct text) > 0.05 * host_docs),
gone as (
  select doc_id, sum(len(lw)) as n_line_words from plain p join frequent f on p.host = f.host and array_to_string(p.lw, ' ') = f.line group by doc_id),
measured as (
  select d.doc_id, cast(len(w) as bigint) as n_words,
         cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
         cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(list_filter(string_split(text, chr(10)), lambda x : regexp_matches(x, '[^\x20\x09-\x0D]')))
              - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x : regexp_matches(x, '[^\x20\x09-\x0D]')))) as bigint) as n_dup_lines,
         cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, cast(coalesce(n_line_words, 0) as bigint) as n_line_words
  from d left join covered c on d.doc_id = c.doc_id left join gone g on d.doc_id = g.doc_id),
judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from measured)
select *, not base_failed and n_words - n_line_words >= 20 and 100 * (n_words - n_line_words) >= 30 * n_words as kept from judged
"""

INTERVAL_DEDUP = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
windows as (select doc_id, n, i, substr(h, 2 * i + 1, 200) as s from (select doc_id, h, n, unnest(range(0, n - 99)) as i from d)),
ordered as (select doc_id, n, i, row_number() over (partition by s order by doc_id, i) as k from windows),
gone as (
  select doc_id, n, i, lag(i) over (partition by doc_id order by i) as before, lead(i) over (partition by doc_id order by i) as after
  from ordered where k > 1),
sums as (
  select doc_id, sum(least(100, coalesce(after, n) - i)) as n_removed, count(*) filter (before is null or i > before + 100) as n_spans
  from gone group by doc_id),
gaps as (
  select doc_id, i + 100 as a, coalesce(after, n) as b from gone where coalesce(after, n) > i + 100
  union all select doc_id, 0, min(i) from gone group by doc_id having min(i) > 0
  union all select doc_id, 0, n from d where doc_id not in (select doc_id from gone)),
kept as (
  select d.doc_id, string_agg(substr(h, cast(2 * a + 1 as bigint), cast(2 * (b - a) as bigint)), '' order by a) as h
  from d join gaps g on d.doc_id = g.doc_id group by d.doc_id)
select d.doc_id, cast(d.n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(k.h, ''))) as kept_sha256
from d left join sums s on d.doc_id = s.doc_id left join kept k on d.doc_id = k.doc_id
"""

NEAR_DUPLICATES = rf"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array({LOWERED}, '[\x20\x09-\x0D]+'), lambda w : w <> '') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                 else list_distinct(list_transform(range(1, len(w) - 3), lambda i : array_to_string(w[i : i + 4], ' '))) end as s
  from d),
items as (select doc_id, unnest(s) as item from sets),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as common from items a join items b on a.item = b.item and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
links as (
  select a, b from pairs p join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * common >= 85 * (len(x.s) + len(y.s) - common)),
reached as (select a, b from links union select r.a, l.b from reached r join links l on r.b = l.a),
lowest as (select a, min(b) as m from reached group by a)
select doc_id, cast(len(s) as bigint) as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id, coalesce(m, doc_id) >= doc_id as kept
from sets left join lowest on doc_id = a
"""

SUBSTRING_TREES = rf"""
with d as (select doc_id, {WORDS} as w from documents),
windows as (
  select doc_id, i, array_to_string(w[i : i + 12], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d)),
firsts as (select doc_id, i, min(doc_id) over (partition by s) as first from windows),
covered as (select distinct doc_id, unnest(range(i, i + 13)) as pos from firsts where first < doc_id),
listed as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from d),
kept as (
  select l.doc_id, count(*) as n, string_agg(word, ' ' order by l.pos) as text
  from listed l left join covered c on l.doc_id = c.doc_id and l.pos = c.pos where c.pos is null group by l.doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(text, '')) as kept_sha256
from d left join kept k on d.doc_id = k.doc_id
"""

_HOST = r"translate(coalesce(regexp_extract({0}, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"coalesce(regexp_extract({0}, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"
_REST = r"regexp_extract({0}, '^.*?://[^/?#]*([^#]*)', 1, 's')"


def _node(url: str) -> str:
    return f"case when contains({url}, '://') then {_HOST.format(url)} || case when {_REST.format(url)} = '' then '/' else {_REST.format(url)} end end"


URL_RULES = rf"""
with recursive rules(rule_host, rule_path, decision) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p as (select page_id, url, html, {_HOST.format("url")} as host, {_PATH.format("url")} as path, {_node("url")} as node from pages),
tags as (
  select url, regexp_extract(unnest(regexp_extract_all(html, '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0, 'is')), '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is') as target
  from p where contains(url, '://')
  union all
  select url, regexp_extract(unnest(regexp_extract_all(html, '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'is')), '\burl\s*=\s*["'']?([^"''\s>]+)', 1, 'is')
  from p where contains(url, '://')),
plain as (
  select url, regexp_replace(target, '&(?:amp|AMP|#0*38|#[xX]0*26);', '&', 'g') as target,
         case when {_PATH.format("url")} = '' then '/' else {_PATH.format("url")} end as own from tags),
led as (
  select *, regexp_extract(target, '^([^?#]*)', 1, 's') as head, regexp_extract(target, '^[^?#]*(.*)$', 1, 's') as rest from plain),
steps as (
  select *, string_split(regexp_replace(regexp_replace(case when starts_with(target, '/') then head else regexp_extract(own, '^(.*/)', 1, 's') || head end,
                                                       '^/', ''), '((?:^|/)[.]{{1,2}})$', '\1/'), '/') as segments from led),
walked as (
  select *, list_reduce(list_concat([cast([] as varchar[])], list_transform(segments, lambda x : [x])),
                        lambda a, x : case when x[1] = '..' then a[1 : greatest(len(a) - 1, 0)] when x[1] = '.' then a else list_concat(a, x) end) as stack
  from steps),
whole as (
  select url, case when regexp_matches(target, '^[a-z][a-z0-9+.-]*://', 'i') then target
                   when starts_with(target, '//') then 'http:' || target
                   when regexp_matches(target, '^[a-z][a-z0-9+.-]*:', 'i') or starts_with(target, '#') or target = '' then null
                   when starts_with(target, '?') then 'http://' || {_HOST.format("url")} || own || target
                   else 'http://' || {_HOST.format("url")} || '/' || coalesce(array_to_string(stack, '/'), '') || rest end as target from walked),
edges as (select {_node("url")} as a, {_node("target")} as b from whole where target is not null),
links as (select a, b from edges where a <> b union select b, a from edges where a <> b),
reached as (select a, b from links union select r.a, l.b from reached r join links l on r.b = l.a),
seen as (select a as node, b from reached union select a, a from links),
voters as (
  select distinct b, {_HOST.format("'x://' || b")} as host, {_PATH.format("'x://' || b")} as path from seen),
paths as (select host, path from p union select host, path from voters),
fitting as (
  select host, path, rule_host || rule_path as rule, decision,
         row_number() over (partition by host, path order by length(rule_host || rule_path) desc, decision) as k
  from paths join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)),
ruled as (select host, path, rule, decision from fitting where k = 1),
votes as (
  select node, min(decision) as voted from seen s join voters v on s.b = v.b join ruled r on r.host = v.host and r.path = v.path group by node)
select page_id, p.host, p.path, rule, coalesce(decision, voted, 'allow') as verdict
from p left join ruled r on p.host = r.host and p.path = r.path left join votes v on p.node = v.node
"""

ORACLES = {
    "op2_line_frequency": LINE_FREQUENCY,
    "op3_interval_dedup": INTERVAL_DEDUP,
    "op5_min_max": NEAR_DUPLICATES,
    "op7_substring_trees": SUBSTRING_TREES,
    "op10_url_rules": URL_RULES,
}
