"""Plain SQL for the operators whose results are trees: the Merkle manifest and the prefix trie."""


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of a short text of single-byte letters, bit by bit."""
    byte = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i : xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda z : cast(ascii(z) as bigint))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b : {byte}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen(cast({value} as varchar)) || ':' || cast({value} as varchar), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _levels(name: str, source: str) -> str:
    return f"""
{name} as (
  select grp, 0 as lvl, place, node from {source}
  union all
  select grp, lvl + 1, place // 8, sha256(string_agg(node, '' order by place))
  from (select *, count(*) over (partition by grp) as n from {name}) where n > 1 group by grp, lvl, place // 8)"""


def _beside(name: str, source: str) -> str:
    return f"""
{name} as (
  select a.grp, a.lvl, a.place, coalesce(string_agg(b.node, '' order by b.place) filter (b.place < a.place), '') as l,
         coalesce(string_agg(b.node, '' order by b.place) filter (b.place > a.place), '') as r
  from {source} a left join {source} b on a.grp = b.grp and a.lvl = b.lvl and a.place // 8 = b.place // 8 and a.place <> b.place
  group by a.grp, a.lvl, a.place)"""


def _path(name: str, source: str, beside: str, levels: str) -> str:
    return f"""
{name} as (
  select s.grp, s.place, list({{'l': l, 'r': r}} order by b.lvl) filter (b.lvl < h.height) as path
  from {source} s join (select grp, max(lvl) as height from {levels} group by grp) h on s.grp = h.grp
  join {beside} b on s.grp = b.grp and b.place = cast(floor(s.place / pow(8, b.lvl)) as bigint) and b.lvl <= h.height
  group by s.grp, s.place)"""


MERKLE_MANIFEST = f"""
with recursive d as (
  select doc_id, lang, coalesce('l' || lang, '-') as grp, {_leaf("text")} as node,
         case when {crc32_sql("cast(doc_id as varchar)")} % 3 = 0 then {_leaf(LOWERED)} end as tampered from documents),
leaves as (select *, row_number() over (partition by grp order by doc_id nulls first, node) - 1 as place from d),
{_levels("low", "leaves")},
low_top as (select grp, arg_max(node, lvl) as node from low group by grp),
subroots as (
  select 'all' as grp, t.grp as name, node, row_number() over (order by lang nulls first) - 1 as place
  from low_top t join (select distinct grp, lang from d) g on t.grp = g.grp),
{_levels("high", "subroots")},
{_beside("low_beside", "low")},
{_beside("high_beside", "high")},
{_path("low_path", "leaves", "low_beside", "low")},
{_path("high_path", "subroots", "high_beside", "high")},
joined as (
  select x.doc_id, x.node as leaf, s.node as subroot, (select arg_max(node, lvl) from high) as root, coalesce(x.tampered, x.node) as told,
         list_concat(coalesce(p.path, []), coalesce(q.path, [])) as path
  from leaves x join low_path p on x.grp = p.grp and x.place = p.place
  join subroots s on s.name = x.grp join high_path q on s.place = q.place),
folded as (
  select *, sha256(array_to_string(list_transform(path, lambda p : p.l || p.r), '')) as proof_sha256,
         list_reduce(list_prepend({{'l': told, 'r': ''}}, path), lambda a, p : {{'l': sha256(p.l || a.l || p.r), 'r': ''}}).l as folded_root
  from joined)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from folded
"""

PREFIX_TRIE = f"""
with own as (
  select conv_id as c, turn, coalesce(role, '') as r, coalesce(text, '') as x from conversations where conv_id is not null),
convs as (
  select c, list({{'r': r, 'x': x}} order by turn nulls first, sha256(strlen(r) || ':' || r || x)) as turns, {crc32_sql("cast(c as varchar)")} % 6 as h
  from own group by c),
rebuilt as (
  select a.c, list_concat(list_slice(coalesce(b.turns, []), 1, a.h), list_slice(a.turns, a.h + 1, len(a.turns))) as turns
  from convs a left join convs b on b.c = a.c - a.c % 100),
prefixes as (select c, d, list_slice(turns, 1, d) as pre, d = len(turns) as ends from (select c, turns, unnest(range(0, len(turns) + 1)) as d from rebuilt)),
nodes as (
  select pre, d, min(c) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (ends), '')) as ends_sha256,
         (count(*) - 1) * case when d = 0 then 0 else length(pre[d].x) end as saved
  from prefixes group by pre, d),
children as (select list_slice(pre, 1, d - 1) as pre, count(*) as n from nodes where d > 0 group by all),
sized as (select n.*, coalesce(k.n, 0) as n_children from nodes n left join children k on n.pre = k.pre),
sums as (
  select list_slice(pre, 1, up) as pre, sum(saved) as saved, count(*) filter (n_children = 0) as n_leaves
  from (select *, unnest(range(0, d + 1)) as up from sized) group by all)
select n.conv_id, n.d as depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, s.n_leaves, cast(s.saved as bigint) as saved_tokens, n.ends_sha256
from sized n join sums s on n.pre = s.pre left join nodes p on n.d > 0 and p.pre = list_slice(n.pre, 1, n.d - 1)
"""

ORACLES = {"op12_bitmap_manifest": MERKLE_MANIFEST, "op13_block_trie": PREFIX_TRIE}
